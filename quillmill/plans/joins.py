"""Queries of lookups, catalog upserts, incremental plans and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import catalog, dedup, incremental
from quillmill.operators.registry import SAMPLE
from quillmill.plans.base import query, read
from quillmill.plans.scans import NOTES, notes, stored

#: Candidates: the latest hit of each note with the policy in force.
POLICY = "198196ffc2edc4c362ade8c4a0237da072d8545ce355e08703fe927227a369a2"
CANDIDATES = f"""cand AS (SELECT guid, updated AS updated_ms, '{POLICY}' AS policy_hash FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY updated DESC, created DESC, title DESC) AS r FROM search_hits) WHERE r = 1)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "search_hits").groupBy("guid").agg(F.max("updated").alias("updated_ms"))
    return hits.withColumn("policy_hash", F.lit(POLICY))


@query("""SELECT h.guid, coalesce(n.name, '未知笔记本') AS notebook, max(h.updated) AS updated FROM search_hits h LEFT JOIN notebooks n ON h.notebook_guid = n.guid GROUP BY 1, 2""")
def notebook_join(spark: SparkSession, d: str) -> DataFrame:
    """Left join with a fixed dimension: Spark broadcasts it by its size, and the fact table is aggregated first."""
    hits = read(spark, d, "search_hits").groupBy("guid", "notebook_guid").agg(F.max("updated").alias("updated"))
    names = read(spark, d, "notebooks").select(F.col("guid").alias("notebook_guid"), "name")
    return hits.join(names, "notebook_guid", "left").groupBy("guid", F.coalesce("name", F.lit("未知笔记本")).alias("notebook")).agg(F.max("updated").alias("updated"))


@query("""SELECT DISTINCT p.notebook_name AS name, n.guid IS NULL AS missing FROM parsed_notes p LEFT JOIN notebooks n ON p.notebook_name = n.name WHERE p.notebook_name IS NOT NULL""")
def names_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Names against a dimension: known or missing."""
    want = read(spark, d, "parsed_notes").where("notebook_name is not null").select(F.col("notebook_name").alias("name")).distinct()
    have = read(spark, d, "notebooks").select("name").distinct().withColumn("have", F.lit(True))
    return want.join(have, "name", "left").select("name", F.col("have").isNull().alias("missing"))


@query(f"""WITH {CANDIDATES} SELECT c.guid, c.updated_ms, CASE
  WHEN EXISTS (SELECT 1 FROM parsed_notes p WHERE p.guid = c.guid AND p.updated_ms = c.updated_ms AND p.policy_hash = c.policy_hash) THEN 'hit'
  WHEN c.guid IN (SELECT guid FROM parsed_notes) THEN 'stale' ELSE 'miss' END AS state FROM cand c""")
def cache_states(spark: SparkSession, d: str) -> DataFrame:
    """Hit, stale or miss of each candidate."""
    return catalog.lookup(candidates(spark, d), read(spark, d, "parsed_notes"), "guid", ["updated_ms", "policy_hash"]).select("guid", "updated_ms", "state")


@query(f"""WITH {CANDIDATES} SELECT c.guid FROM cand c WHERE NOT EXISTS (SELECT 1 FROM parsed_notes p WHERE p.guid = c.guid AND p.updated_ms = c.updated_ms AND p.policy_hash = c.policy_hash)""")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose body is needed."""
    return catalog.misses(candidates(spark, d), read(spark, d, "parsed_notes"), "guid", ["updated_ms", "policy_hash"]).select("guid")


@query(f"""WITH {CANDIDATES} SELECT d.doc_id, c.guid FROM cand c JOIN documents d ON d.source_guid = c.guid
WHERE NOT EXISTS (SELECT 1 FROM parsed_notes p WHERE p.guid = c.guid AND p.updated_ms = c.updated_ms AND p.policy_hash = c.policy_hash)""")
def bodies_needed(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of the misses only: the text column is read behind the anti join."""
    miss = catalog.misses(candidates(spark, d), read(spark, d, "parsed_notes"), "guid", ["updated_ms", "policy_hash"])
    return read(spark, d, "documents").join(miss, F.col("source_guid") == miss["guid"]).select("doc_id", "guid")


@query("""SELECT selection_hash, count(DISTINCT k.guid) AS current FROM keyword_analyses k
WHERE EXISTS (SELECT 1 FROM (SELECT guid, max(updated) AS u FROM search_hits GROUP BY 1) h WHERE h.guid = k.guid AND h.u = k.updated_ms) GROUP BY 1""")
def keyword_cache_current(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that the cache of each selection has in their present version."""
    now = candidates(spark, d).select("guid", "updated_ms")
    return read(spark, d, "keyword_analyses").join(now, ["guid", "updated_ms"], "left_semi").groupBy("selection_hash").agg(F.count_distinct("guid").alias("current"))


@query("""WITH r AS (SELECT guid, max(updated) AS updated FROM search_hits GROUP BY 1), l AS (SELECT source_guid AS guid, max(epoch_ms(updated)) AS updated FROM documents WHERE source_guid IS NOT NULL GROUP BY 1)
SELECT r.guid, CASE WHEN l.guid IS NULL THEN 'new' WHEN r.updated > coalesce(l.updated, -1) THEN 'update' ELSE 'skip' END AS action FROM r LEFT JOIN l ON r.guid = l.guid""")
def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    remote = read(spark, d, "search_hits").groupBy("guid").agg(F.max("updated").alias("updated"))
    return incremental.sync_plan(remote, stored(spark, d).where("guid is not null")).select("guid", "action")


HISTORY = "hist AS (SELECT source_guid AS guid, title, epoch_ms(updated) AS updated, epoch_ms(created) AS created, path FROM documents WHERE source_guid IS NOT NULL AND updated IS NOT NULL)"


def history(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).where("guid is not null and updated is not null")


@query(f"""WITH {NOTES}, {HISTORY}, o AS (SELECT STRIP(title) AS t, max({{'u': updated, 'c': created, 'g': guid}}) AS o FROM hist WHERE STRIP(title) <> '' GROUP BY 1)
SELECT n.guid, CASE WHEN o.o > {{'u': n.updated, 'c': n.created, 'g': n.guid}} AND o.o.g <> n.guid THEN o.o.g END AS rejected_by FROM notes n LEFT JOIN o ON STRIP(n.title) = o.t""")
def history_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Notes that a strictly fresher stored note of their title outranks."""
    return incremental.against_history(notes(spark, d), history(spark, d)).select("guid", "rejected_by")


@query(f"""WITH {NOTES}, {HISTORY}, o AS (SELECT STRIP(title) AS t, max({{'u': updated, 'c': created, 'g': guid}}) AS o FROM notes WHERE ok AND STRIP(title) <> '' GROUP BY 1)
SELECT h.guid, h.path, o.o.g AS replaced_by FROM hist h JOIN o ON STRIP(h.title) = o.t WHERE {{'u': h.updated, 'c': h.created, 'g': h.guid}} < o.o AND h.guid <> o.o.g""")
def history_outdated(spark: SparkSession, d: str) -> DataFrame:
    """Stored notes that a fresher accepted note of their title replaces."""
    return incremental.outdated(history(spark, d), notes(spark, d).where("ok")).select("guid", "path", "replaced_by")


# ---- the catalog as a table

BATCH = """batch AS (SELECT guid, updated_ms, title, summary, 'accepted' AS outcome, canonical_path, CAST(arrived_at AS VARCHAR) AS fetched FROM incoming_notes WHERE guid IS NOT NULL),
old AS (SELECT guid, updated_ms, title, summary, outcome, canonical_path, first_fetched_at, last_seen_at FROM parsed_notes)"""


def _entry(df: DataFrame, fetched: str) -> DataFrame:
    return df.select("guid", "updated_ms", "title", "summary", F.col(fetched).cast("string").alias("first_fetched_at"))


@query("""
WITH b AS (SELECT guid, updated_ms, title, summary, CAST(arrival_id AS VARCHAR) AS f FROM incoming_notes WHERE guid IS NOT NULL),
o AS (SELECT guid, updated_ms, title, summary, first_fetched_at AS f FROM parsed_notes),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY updated_ms DESC, title DESC NULLS LAST, summary DESC NULLS LAST, f DESC NULLS LAST) AS r FROM b) WHERE r = 1),
ob AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY updated_ms DESC, title DESC NULLS LAST, summary DESC NULLS LAST, f DESC NULLS LAST) AS r FROM o) WHERE r = 1)
SELECT coalesce(nb.guid, ob.guid) AS guid, CASE WHEN nb.guid IS NULL THEN ob.updated_ms ELSE nb.updated_ms END AS updated_ms, CASE WHEN nb.guid IS NULL THEN ob.title ELSE nb.title END AS title,
  CASE WHEN nb.guid IS NULL THEN ob.summary ELSE nb.summary END AS summary, coalesce(ob.f, nb.f) AS first_fetched_at FROM nb FULL JOIN ob ON nb.guid = ob.guid""")
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals upserted into the catalog; the first fetch time of known notes stays."""
    batch = _entry(read(spark, d, "incoming_notes").where("guid is not null"), "arrival_id")
    return catalog.upsert(_entry(read(spark, d, "parsed_notes"), "first_fetched_at"), batch, ["guid"], ["first_fetched_at"], ["updated_ms"])


@query("""
WITH k AS (SELECT guid, selection_hash, outcome, first_fetched_at, updated_ms, last_seen_at >= '2026' AS fresh FROM keyword_analyses),
f AS (SELECT *, row_number() OVER (PARTITION BY fresh, guid, selection_hash ORDER BY updated_ms DESC, outcome DESC NULLS LAST, first_fetched_at DESC NULLS LAST) AS r FROM k),
n AS (SELECT * FROM f WHERE r = 1 AND fresh), o AS (SELECT * FROM f WHERE r = 1 AND NOT fresh)
SELECT coalesce(n.guid, o.guid) AS guid, coalesce(n.selection_hash, o.selection_hash) AS selection_hash, CASE WHEN n.guid IS NULL THEN o.updated_ms ELSE n.updated_ms END AS updated_ms,
  CASE WHEN n.guid IS NULL THEN o.outcome ELSE n.outcome END AS outcome, coalesce(o.first_fetched_at, n.first_fetched_at) AS first_fetched_at FROM n FULL JOIN o ON n.guid = o.guid AND n.selection_hash = o.selection_hash""")
def keyword_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A catalog with a key of two columns: the rows seen since 2026 upserted into those seen before."""
    rows = read(spark, d, "keyword_analyses")
    part = lambda cond: rows.where(cond).select("guid", "selection_hash", "updated_ms", "outcome", "first_fetched_at")
    fresh = F.col("last_seen_at") >= "2026"
    return catalog.upsert(part(~fresh), part(fresh), ["guid", "selection_hash"], ["first_fetched_at"], ["updated_ms"])


@query("""SELECT guid, updated_ms, CASE WHEN guid IN (SELECT guid FROM incoming_notes) THEN '2026-09-01T00:00:00Z' ELSE last_seen_at END AS last_seen_at FROM parsed_notes""")
def catalog_touch(spark: SparkSession, d: str) -> DataFrame:
    """last_seen_at of the notes that arrived again."""
    table = read(spark, d, "parsed_notes").select("guid", "updated_ms", "last_seen_at")
    return catalog.touch(table, read(spark, d, "incoming_notes"), ["guid"], "last_seen_at", "2026-09-01T00:00:00Z")


@query("""SELECT 'total' AS what, NULL AS name, count(*) AS n FROM parsed_notes UNION ALL SELECT 'outcome', outcome, count(*) FROM parsed_notes GROUP BY 2
UNION ALL SELECT 'domain', primary_domain, count(*) FROM parsed_notes WHERE trim(primary_domain) <> '' GROUP BY 2""")
def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.stats(read(spark, d, "parsed_notes"))


@query("""SELECT selection_hash, outcome, primary_domain, count(*) AS n FROM keyword_analyses GROUP BY 1, 2, 3""")
def keyword_stats(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "keyword_analyses").groupBy("selection_hash", "outcome", "primary_domain").agg(F.count("*").alias("n"))


@query("""SELECT guid, string_agg(search_keyword, ',' ORDER BY search_keyword) AS keywords, count(*) AS n FROM (SELECT DISTINCT guid, search_keyword FROM search_hits) GROUP BY 1""")
def keywords_of_note(spark: SparkSession, d: str) -> DataFrame:
    """The keywords that found each note."""
    pairs = read(spark, d, "search_hits").select("guid", "search_keyword").distinct()
    return pairs.groupBy("guid").agg(F.array_join(F.array_sort(F.collect_list("search_keyword")), ",").alias("keywords"), F.count("*").alias("n"))


@query("""SELECT search_keyword AS keyword, count(*) AS hits, count(DISTINCT guid) AS notes, CAST(sum(content_length) AS DOUBLE) AS chars FROM search_hits GROUP BY 1""")
def keyword_rollup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "search_hits").groupBy(F.col("search_keyword").alias("keyword")).agg(F.count("*").alias("hits"), F.count_distinct("guid").alias("notes"), F.sum("content_length").cast("double").alias("chars"))


_CANON = f"CASE WHEN trim(primary_domain) IN ({', '.join(repr(n) for n in SAMPLE.names)}) THEN trim(primary_domain) " + " ".join(f"WHEN trim(primary_domain) = '{a}' THEN '{b}'" for a, b in SAMPLE.aliases.items()) + " END"


@query(f"SELECT primary_domain AS name, {_CANON} AS domain, count(*) AS n FROM parsed_notes GROUP BY 1, 2")
def canonical_domains(spark: SparkSession, d: str) -> DataFrame:
    """Stored names against the registry and its aliases."""
    counts = read(spark, d, "parsed_notes").groupBy(F.col("primary_domain").alias("name")).agg(F.count("*").alias("n"))
    return counts.select("name", SAMPLE.canonical(F.col("name")).alias("domain"), "n")


@query(f"""SELECT guid, updated_ms, canonical_path, {_CANON} || regexp_replace(canonical_path, '^[^/]+', '') AS new_path FROM parsed_notes
WHERE trim(canonical_path) <> '' AND {_CANON} || regexp_replace(canonical_path, '^[^/]+', '') <> canonical_path""")
def taxonomy_rename(spark: SparkSession, d: str) -> DataFrame:
    """Paths that change when domains get their present names."""
    new = F.concat(SAMPLE.canonical(F.col("primary_domain")), F.regexp_replace("canonical_path", "^[^/]+", ""))
    rows = read(spark, d, "parsed_notes").where("trim(canonical_path) <> ''").select("guid", "updated_ms", "canonical_path", new.alias("new_path"))
    return rows.where("new_path <> canonical_path")


@query("""WITH a AS (SELECT DISTINCT guid FROM search_hits), b AS (SELECT DISTINCT guid FROM parsed_notes)
SELECT guid, 'missing' AS side FROM (SELECT guid FROM a EXCEPT SELECT guid FROM b) UNION ALL SELECT guid, 'unexpected' FROM (SELECT guid FROM b EXCEPT SELECT guid FROM a)""")
def set_differences(spark: SparkSession, d: str) -> DataFrame:
    """Found but not analysed, and analysed but not found: one full outer join for both sides."""
    side = lambda t, c: read(spark, d, t).select("guid").distinct().withColumn(c, F.lit(True))
    both = side("search_hits", "a").join(side("parsed_notes", "b"), "guid", "full_outer")
    return both.where("a is null or b is null").select("guid", F.when(F.col("b").isNull(), "missing").otherwise("unexpected").alias("side"))


@query("""SELECT guid, count(*) AS n, max(updated) AS updated FROM (
  SELECT guid, updated FROM search_hits UNION ALL SELECT guid, updated_ms FROM keyword_analyses UNION ALL SELECT guid, updated_ms FROM parsed_notes) GROUP BY 1""")
def batch_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [read(spark, d, "search_hits").select("guid", "updated")] + [read(spark, d, t).select("guid", F.col("updated_ms").alias("updated")) for t in ("keyword_analyses", "parsed_notes")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("guid").agg(F.count("*").alias("n"), F.max("updated").alias("updated"))




@query("""WITH b AS (SELECT guid, max(updated_ms) AS v, count(*) AS s FROM keyword_analyses GROUP BY 1), a AS (SELECT guid, max(updated_ms) AS v, count(*) AS s FROM parsed_notes GROUP BY 1)
SELECT coalesce(a.guid, b.guid) AS path, CASE WHEN b.guid IS NULL THEN 'added' WHEN a.guid IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CAST(b.v AS VARCHAR) AS before_sha, CAST(a.v AS VARCHAR) AS after_sha, b.s AS before_size, a.s AS after_size FROM a FULL JOIN b ON a.guid = b.guid WHERE a.v IS DISTINCT FROM b.v""")
def changed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Two states as a change table."""
    state = lambda t: read(spark, d, t).groupBy(F.col("guid").alias("path")).agg(F.max("updated_ms").cast("string").alias("sha"), F.count("*").alias("size"))
    return incremental.changes(state("keyword_analyses"), state("parsed_notes"))


@query("""WITH m AS (SELECT canonical_path AS path, min(primary_domain) AS d FROM parsed_notes WHERE trim(canonical_path) <> '' AND trim(primary_domain) <> '' AND primary_domain <> split_part(canonical_path, '/', 1) GROUP BY 1)
SELECT doc_id, x.path, CASE WHEN m.d IS NULL THEN x.path ELSE m.d || regexp_replace(x.path, '^[^/]+', '') END AS final FROM documents x LEFT JOIN m ON x.path = m.path WHERE x.path IS NOT NULL""")
def final_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where moves put the stored documents."""
    p = read(spark, d, "parsed_notes").where("trim(canonical_path) <> '' and trim(primary_domain) <> ''").where(F.col("primary_domain") != F.split_part("canonical_path", F.lit("/"), F.lit(1)))
    moves = p.groupBy(F.col("canonical_path").alias("path")).agg(F.min("primary_domain").alias("domain"))
    return incremental.final_paths(read(spark, d, "documents").where("path is not null").select("doc_id", "path"), moves).select("doc_id", "path", "final")


@query("""WITH c AS (SELECT guid, arg_max({'o': outcome, 'p': canonical_path}, {'a': outcome = 'accepted', 'p': coalesce(canonical_path, '')}) AS c FROM parsed_notes GROUP BY 1),
j AS (SELECT d.source_guid AS guid, d.path, CASE WHEN c.o <> 'accepted' THEN c.o WHEN trim(c.p) = '' THEN NULL WHEN c.p <> d.path THEN 'not canonical' END AS reason
  FROM documents d JOIN c ON d.source_guid = c.guid WHERE d.path IS NOT NULL)
SELECT * FROM j WHERE reason IS NOT NULL""")
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Stored files that the catalog doesn't want where they are."""
    docs = read(spark, d, "documents").select(F.col("source_guid").alias("guid"), "path")
    return incremental.quarantine(docs, read(spark, d, "parsed_notes"))
