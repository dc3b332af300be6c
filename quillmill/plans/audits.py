"""Queries of links, attachments, integrity, lint and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import attachments, index, integrity, links
from quillmill.operators.registry import SAMPLE
from quillmill.plans.base import query, read


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


_EDGES = r"""e AS (SELECT doc_id, path, domain, unnest(regexp_extract_all(text, '(!?\[[^\]]*\]\([^)\s]+\))', 1)) AS raw FROM documents),
edges AS (SELECT doc_id, path, domain, regexp_extract(raw, '\(([^)]+)\)$', 1) AS target, starts_with(raw, '!') AS is_image FROM e)"""


@query(f"WITH {_EDGES} SELECT doc_id, target, is_image, count(*) AS n FROM edges GROUP BY 1, 2, 3")
def references(spark: SparkSession, d: str) -> DataFrame:
    """Regular inline links, without Python."""
    return links.edges_native(docs(spark, d), "doc_id", "text").groupBy(F.col("src").alias("doc_id"), "target", "is_image").agg(F.count("*").alias("n"))


@query()
def references_exact(spark: SparkSession, d: str) -> DataFrame:
    """All references outside code: nested brackets, titles, wikilinks."""
    return links.edges(docs(spark, d), "doc_id", "text").withColumnRenamed("src", "doc_id")


@query(f"""WITH {_EDGES} SELECT count(*) AS refs, count_if(is_image) AS images, count_if(NOT is_image AND NOT regexp_matches(target, '^[a-z]+:')) AS local_links,
  count_if(regexp_matches(target, '^[a-z]+:')) AS remote, count(DISTINCT doc_id) AS docs FROM edges""")
def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    e = links.edges_native(docs(spark, d), "doc_id", "text")
    remote = F.col("target").rlike("^[a-z]+:")
    return e.agg(F.count("*").alias("refs"), F.count_if("is_image").alias("images"), F.count_if(~F.col("is_image") & ~remote).alias("local_links"), F.count_if(remote).alias("remote"), F.count_distinct("src").alias("docs"))


@query(f"""WITH {_EDGES}, n AS (SELECT target, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM edges GROUP BY 1)
SELECT edges.doc_id, edges.target, n.docs FROM edges JOIN n ON edges.target = n.target WHERE n.docs > 1 AND edges.doc_id <> n.first_doc GROUP BY ALL""")
def shared_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Files that several documents refer to."""
    e = links.edges_native(docs(spark, d), "doc_id", "text").select(F.col("src").alias("doc_id"), "target").distinct()
    n = e.groupBy("target").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).where("docs > 1")
    return e.join(n, "target").where("doc_id <> first_doc").select("doc_id", "target", "docs")


@query(f"""WITH {_EDGES}, owned AS (SELECT DISTINCT target FROM edges WHERE path IS NOT NULL)
SELECT DISTINCT 'missing_attachment' AS kind, domain, path, target AS detail FROM edges WHERE target NOT IN (SELECT target FROM owned)""")
def missing_attachments(spark: SparkSession, d: str) -> DataFrame:
    """References to files that no stored document (one with a path) has."""
    text = docs(spark, d)
    found = F.regexp_extract_all("text", F.lit(r"(!?\[[^\]]*\]\([^)\s]+\))"), F.lit(1))
    e = text.select("domain", "path", F.explode(found).alias("raw")).select("domain", "path", F.regexp_extract("raw", r"\(([^)]+)\)$", 1).alias("target"))
    files = e.where("path is not null").select(F.col("target").alias("path"))
    return integrity.missing_targets(e, files).distinct()


#: Links between documents: each to the newest other document of its title, by title and domain folder.
_PAIRS = """x AS (SELECT doc_id, path, STRIP(title) AS t, created FROM documents WHERE path IS NOT NULL),
n AS (SELECT doc_id, path, lead(path) OVER (PARTITION BY t ORDER BY created, doc_id) AS nxt, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.md$', '') AS name FROM x)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    """(a, b): from each stored document to the next of its title."""
    from pyspark.sql import Window

    w = Window.partitionBy(T.strip(F.col("title"))).orderBy("created", "doc_id")
    x = docs(spark, d).where("path is not null").select(F.col("path").alias("a"), F.lead("path").over(w).alias("b"))
    return x.where("b is not null")


@query(f"WITH {_PAIRS}, e AS (SELECT DISTINCT path AS a, nxt AS b FROM n WHERE nxt IS NOT NULL AND nxt <> path) SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.a = e.b AND r.b = e.a)")
def one_sided_links(spark: SparkSession, d: str) -> DataFrame:
    return links.one_sided(_links(spark, d))


@query(f"""WITH {_PAIRS}, e AS (SELECT path AS a, nxt AS b FROM n WHERE nxt IS NOT NULL), p AS (SELECT a, b, count(*) AS n FROM e GROUP BY 1, 2)
SELECT a, 'duplicate_link' AS kind, b AS detail FROM p WHERE n > 1 UNION ALL SELECT a, 'self_link', b FROM p WHERE a = b
UNION ALL SELECT a, 'too_many_links', CAST(count(*) AS VARCHAR) FROM p GROUP BY a HAVING count(*) > 3""")
def link_rules(spark: SparkSession, d: str) -> DataFrame:
    return links.link_rules(_links(spark, d))


@query(f"""WITH {_PAIRS} SELECT DISTINCT path FROM n WHERE path NOT IN (SELECT nxt FROM n WHERE nxt IS NOT NULL)""")
def orphan_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no link points at."""
    have = docs(spark, d).where("path is not null").select("path").distinct()
    return links.orphans(have, _links(spark, d).select(F.col("b").alias("resolved")))


@query(f"""WITH {_PAIRS}, k AS (SELECT DISTINCT path, CASE WHEN type = '知识' THEN 2 ELSE 1 END AS least FROM documents WHERE path IS NOT NULL AND domain IS NOT NULL),
h AS (SELECT path, count(DISTINCT nxt) AS n FROM n WHERE nxt IS NOT NULL GROUP BY 1) SELECT k.path, k.least, coalesce(h.n, 0) AS n FROM k LEFT JOIN h ON k.path = h.path WHERE coalesce(h.n, 0) < k.least""")
def few_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents with fewer linked sources than their type asks for."""
    have = docs(spark, d).where("path is not null and domain is not null").select("path", F.when(F.col("type") == "知识", 2).otherwise(1).alias("least")).distinct()
    return links.few_sources(have, _links(spark, d).withColumnRenamed("b", "resolved")).select("path", "least", "n")


@query(f"""WITH {_PAIRS} SELECT path AS a, '<!-- links:start -->' || chr(10) || string_agg(DISTINCT '- [[' || nxt || ']]', chr(10) ORDER BY '- [[' || nxt || ']]') || chr(10) || '<!-- links:end -->' AS block
FROM n WHERE nxt IS NOT NULL AND nxt <> path GROUP BY 1""")
def link_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The sorted links of each document as a controlled block."""
    return links.link_block(_links(spark, d))


_RESOLVED = r"""p AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL),
s AS (SELECT regexp_replace(regexp_replace(path, '^.*/', ''), '(?i)\.md$', '') AS name, count(*) AS n FROM p WHERE ends_with(lower(path), '.md') GROUP BY 1),
t AS (SELECT *, regexp_matches(u, '[^/]\.[^./]+$') AS ending, regexp_replace(coalesce(path, ''), '/?[^/]*$', '') AS dir FROM (SELECT *, url_decode(replace(replace(target, '\', '/'), '+', '%2B')) AS u FROM l)),
m AS (SELECT *, CASE WHEN ending THEN u ELSE u || '.md' END AS full_name FROM t),
resolved AS (SELECT m.*, CASE WHEN regexp_matches(u, '(^|/)\.\.(/|$)|^/') THEN 'outside' WHEN CASE WHEN dir = '' THEN full_name ELSE dir || '/' || full_name END IN (SELECT path FROM p) THEN 'relative'
  WHEN full_name IN (SELECT path FROM p) THEN 'root' WHEN s.n = 1 THEN 'name' WHEN s.n > 1 THEN 'ambiguous' ELSE 'missing' END AS reason
  FROM m LEFT JOIN s ON s.name = CASE WHEN NOT contains(u, '/') AND NOT ending THEN u END)"""


@query(rf"""WITH l AS (SELECT doc_id, path, title AS target FROM documents UNION ALL SELECT doc_id, path, split_part(replace(path, '/', '\'), '.md', 1) FROM documents WHERE path IS NOT NULL),
{_RESOLVED} SELECT doc_id, target, reason, count(*) AS n FROM resolved GROUP BY 1, 2, 3""")
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Links from each document to every title as a bare name, and to its own path with turned slashes and no ending."""
    x = docs(spark, d)
    own = x.where("path is not null").select("doc_id", F.col("path").alias("src_path"), F.split_part(F.replace("path", F.lit("/"), F.lit("\\")), F.lit(".md"), F.lit(1)).alias("target"))
    l = x.select("doc_id", F.col("path").alias("src_path"), F.col("title").alias("target")).unionByName(own)  # noqa: E741
    return links.resolve(l, x.select("path")).groupBy("doc_id", "target", "reason").agg(F.count("*").alias("n"))


@query(rf"""WITH {_EDGES}, l AS (SELECT doc_id, path, target FROM edges WHERE NOT regexp_matches(target, '^[a-z]+:')), {_RESOLVED}
SELECT doc_id, target, reason, count(*) AS n FROM resolved GROUP BY 1, 2, 3""")
def reference_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The local references of the texts, resolved against the stored documents."""
    x = docs(spark, d)
    e = links.edges_native(x, "doc_id", "text").where(~F.col("target").rlike("^[a-z]+:"))
    l = e.join(x.select(F.col("doc_id").alias("src"), F.col("path").alias("src_path")), "src").select(F.col("src").alias("doc_id"), "src_path", "target")  # noqa: E741
    return links.resolve(l, x.select("path")).groupBy("doc_id", "target", "reason").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, CASE WHEN ends_with(lower(regexp_replace(split_part(title, '|', 1), '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')), '.md') THEN regexp_replace(split_part(title, '|', 1), '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') ELSE regexp_replace(regexp_replace(split_part(title, '|', 1), '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g'), '#.*$', '') END AS target FROM documents""")
def wikilink_targets(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", links.wikilink_target(F.col("title")).alias("target"))


@query(r"""WITH e AS (SELECT domain AS folder, unnest(regexp_extract_all(text, '\]\(_attachments/([^)\s]+)\)', 1)) AS name, sha256(coalesce(source, '')) AS sha FROM documents),
x AS (SELECT DISTINCT folder, name, sha FROM e), y AS (SELECT *, dense_rank() OVER (PARTITION BY folder, name ORDER BY sha) AS pl FROM x)
SELECT folder, name, sha, CASE WHEN pl = 1 THEN name ELSE regexp_replace(name, '\.[^.]*$', '') || '_' || substr(sha, 1, 12) || regexp_extract(name, '(\.[^.]*)$', 1) END AS stored FROM y""")
def attachment_names(spark: SparkSession, d: str) -> DataFrame:
    """Names under which files of one name and different content are stored."""
    found = F.regexp_extract_all("text", F.lit(r"\]\(_attachments/([^)\s]+)\)"), F.lit(1))
    e = docs(spark, d).select(F.col("domain").alias("folder"), F.explode(found).alias("name"), F.sha2(F.coalesce("source", F.lit("")), 256).alias("sha")).distinct()
    return attachments.stored_names(e)


# ---- integrity

_DOCS = "d AS (SELECT doc_id, source_guid AS guid, domain, path, title, created FROM documents)"
_META = """SELECT 'metadata_error' AS kind, domain, path, CASE WHEN created IS NULL THEN 'created' ELSE 'guid' END AS detail FROM d WHERE created IS NULL OR guid IS NULL OR trim(guid) = ''
UNION ALL SELECT 'domain_mismatch', domain, path, split_part(path, '/', 1) FROM d WHERE path IS NOT NULL AND domain IS NOT NULL AND split_part(path, '/', 1) <> domain
UNION ALL SELECT 'duplicate_guid', domain, min(path), guid FROM d WHERE trim(guid) <> '' GROUP BY domain, guid HAVING count(*) > 1
UNION ALL SELECT 'duplicate_title', domain, min(path), title FROM d WHERE STRIP(title) <> '' GROUP BY domain, title HAVING count(*) > 1"""
_ACROSS = """SELECT 'duplicate_across' AS kind, string_agg(domain, ',' ORDER BY domain) AS domain, min(path) AS path, title AS detail
FROM (SELECT title, domain, min(path) AS path FROM d WHERE STRIP(title) <> '' AND domain IS NOT NULL GROUP BY 1, 2) GROUP BY title HAVING count(*) > 1"""


def stored(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.col("source_guid").alias("guid"), "domain", "path", "title", "created")


def _issues(spark: SparkSession, d: str) -> DataFrame:
    s = stored(spark, d)
    return integrity.metadata(s).unionByName(integrity.duplicates(s, "guid", "duplicate_guid")).unionByName(integrity.duplicates(s, "title", "duplicate_title"))


@query(f"WITH {_DOCS} {_META}")
def integrity_issues(spark: SparkSession, d: str) -> DataFrame:
    """Identity, folders and duplicates within domains."""
    return _issues(spark, d)


@query(f"WITH {_DOCS} {_ACROSS}")
def duplicates_across(spark: SparkSession, d: str) -> DataFrame:
    """Titles in more than one domain."""
    return integrity.across(stored(spark, d), "title", "duplicate_across")


@query(f"WITH {_DOCS} SELECT kind, count(*) AS n FROM ({_META} UNION ALL {_ACROSS}) GROUP BY 1")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return integrity.summary(_issues(spark, d).unionByName(integrity.across(stored(spark, d), "title", "duplicate_across")))


_INDEX = "docs AS (SELECT domain, path FROM documents WHERE path IS NOT NULL), ent AS (SELECT primary_domain AS domain, canonical_path AS path FROM parsed_notes WHERE outcome = 'accepted' AND trim(canonical_path) <> '' AND primary_domain <> 'Quant')"


@query(f"""WITH {_INDEX} SELECT DISTINCT 'missing_index_target' AS kind, domain, path, path AS detail FROM ent WHERE NOT EXISTS (SELECT 1 FROM docs WHERE docs.domain = ent.domain AND docs.path = ent.path)
UNION ALL SELECT DISTINCT 'index_missing_article', domain, path, path FROM docs WHERE domain IN (SELECT domain FROM ent) AND NOT EXISTS (SELECT 1 FROM ent WHERE docs.domain = ent.domain AND docs.path = ent.path)
UNION ALL SELECT DISTINCT 'missing_index', domain, NULL, domain FROM docs WHERE domain IS NOT NULL AND domain NOT IN (SELECT domain FROM ent WHERE domain IS NOT NULL)
UNION ALL SELECT 'index_extra_article', domain, path, CAST(count(*) AS VARCHAR) FROM ent GROUP BY domain, path HAVING count(*) > 1""")
def index_drift(spark: SparkSession, d: str) -> DataFrame:
    """An index made from the catalog against the stored documents."""
    p = read(spark, d, "parsed_notes").where("outcome = 'accepted' and trim(canonical_path) <> '' and primary_domain <> 'Quant'")
    return integrity.index_drift(p.select(F.col("primary_domain").alias("domain"), F.col("canonical_path").alias("path")), docs(spark, d).select("domain", "path"))


ALLOWED_WORDS = ["大模型", "针灸", "血压", "科举", "回测"]


@query(f"""WITH c AS (SELECT guid, max({{'ok': outcome = 'accepted', 'p': canonical_path}}) AS c FROM keyword_analyses GROUP BY 1),
j AS (SELECT d.source_guid AS guid, d.domain, d.path, d.created, c.c FROM documents d LEFT JOIN c ON d.source_guid = c.guid WHERE d.path IS NOT NULL)
SELECT 'out_of_range_article' AS kind, domain, path, guid AS detail FROM j WHERE NOT (created >= TIMESTAMP '2023-06-01' AND created < TIMESTAMP '2025-06-01')
UNION ALL SELECT 'missing_keyword_cache', domain, path, guid FROM j WHERE c IS NULL UNION ALL SELECT 'unexpected_canonical_file', domain, path, guid FROM j WHERE NOT c.ok
UNION ALL SELECT 'canonical_path_mismatch', domain, path, guid FROM j WHERE c.ok AND c.p IS DISTINCT FROM path""")
def keyword_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents against the keyword catalog; the order of null paths is that of a null as smallest."""
    cache = read(spark, d, "keyword_analyses").select("guid", "outcome", "canonical_path", F.array().cast("array<string>").alias("keywords"))
    found = integrity.selection(stored(spark, d), cache, ALLOWED_WORDS, "2023-06-01", "2025-06-01")
    return found.where("kind <> 'matched_keywords_invalid'")


@query()
def keywords_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Cached selections with keywords outside a job's; broken JSON counts as no keyword."""
    k = read(spark, d, "keyword_analyses").withColumn("k", F.from_json("matched_keywords_json", "array<string>"))
    extra = F.array_except("k", F.array(*[F.lit(w) for w in ALLOWED_WORDS]))
    return k.where(F.size(extra) > 0).select("guid", "selection_hash", F.concat_ws(",", extra).alias("outside"))


_F = r"""nullif(trim(regexp_extract(regexp_extract(text, '\A---\r?\n((?s:.*?))\r?\n---[ \t]*(\r?\n|\z)', 1), '(?m)^{0}:([^\r\n]*)', 1)), '')"""
_DOMAINS = ", ".join(f"'{n}'" for n in SAMPLE.names)


@query(f"""WITH x AS (SELECT domain, path, {_F.format('type')} AS t, {_F.format('domain')} AS m FROM documents WHERE starts_with(text, '---'))
SELECT CASE WHEN t IS NULL THEN 'INVALID_FRONTMATTER' ELSE 'INVALID_PROPERTY_VALUE' END AS kind, domain, path, CASE WHEN t IS NULL THEN 'type' ELSE 'type=' || t END AS detail FROM x WHERE t IS NULL OR t <> '资料'
UNION ALL SELECT CASE WHEN m IS NULL THEN 'INVALID_FRONTMATTER' ELSE 'INVALID_PROPERTY_VALUE' END, domain, path, CASE WHEN m IS NULL THEN 'domain' ELSE 'domain=' || m END FROM x WHERE m IS NULL OR m NOT IN ({_DOMAINS})""")
def lint_properties(spark: SparkSession, d: str) -> DataFrame:
    """Header fields that are missing or have another value than allowed."""
    x = docs(spark, d).where(F.col("text").startswith("---")).select("domain", "path", F.map_filter(T.header_fields(F.col("text")), lambda k, v: v != "").alias("fields"))
    return integrity.properties(x, {"type": ["资料"], "domain": SAMPLE.names})


@query("""SELECT doc_id, (length(text) - length(replace(text, '# ', ''))) = 2 AND (length(text) - length(replace(text, '## ', ''))) = 3 AND instr(text, '# ') < instr(text, '## ') AS valid FROM documents""")
def regions_valid(spark: SparkSession, d: str) -> DataFrame:
    """One start mark and one end mark in order; here heading marks stand for them."""
    return docs(spark, d).select("doc_id", integrity.region_valid(F.col("text"), "# ", "## ").alias("valid"))


@query("""WITH x AS (SELECT guid, updated_ms, last_seen_at, row_number() OVER (ORDER BY guid, updated_ms, last_seen_at) AS pos FROM (SELECT DISTINCT guid, updated_ms, last_seen_at FROM parsed_notes WHERE primary_domain = 'Quant')),
y AS (SELECT *, CAST(last_seen_at AS TIMESTAMPTZ) AS t, replace(regexp_extract(last_seen_at, '(Z|[+-][0-9]{2}:[0-9]{2})$', 1), 'Z', '+00:00') AS off FROM x),
z AS (SELECT *, lag(t) OVER (ORDER BY pos) AS before, lag(off) OVER (ORDER BY pos) AS off_before FROM y)
SELECT guid, updated_ms, CASE WHEN t < before THEN 'goes_back' WHEN off <> off_before THEN 'other_offset' END AS problem FROM z""")
def log_order(spark: SparkSession, d: str) -> DataFrame:
    """An ordered log (one domain's notes stand for it): times that go back, and changes of offset."""
    x = read(spark, d, "parsed_notes").where("primary_domain = 'Quant'").select("guid", "updated_ms", "last_seen_at").distinct()
    x = x.withColumn("pos", F.struct("guid", "updated_ms", "last_seen_at"))
    return integrity.log_order(x, "pos", "last_seen_at").select("guid", "updated_ms", "problem")


@query("""WITH x AS (SELECT guid, updated_ms, last_seen_at, row_number() OVER (ORDER BY guid NULLS FIRST, updated_ms NULLS FIRST, last_seen_at NULLS FIRST) AS pos FROM (SELECT DISTINCT guid, updated_ms, last_seen_at FROM parsed_notes)),
y AS (SELECT *, CAST(last_seen_at AS TIMESTAMPTZ) AS t, replace(regexp_extract(last_seen_at, '(Z|[+-][0-9]{2}:[0-9]{2})$', 1), 'Z', '+00:00') AS off FROM x),
z AS (SELECT *, lag(t) OVER (ORDER BY pos) AS before, lag(off) OVER (ORDER BY pos) AS off_before FROM y)
SELECT guid, updated_ms, CASE WHEN t < before THEN 'goes_back' WHEN off <> off_before THEN 'other_offset' END AS problem FROM z""")
def log_order_all(spark: SparkSession, d: str) -> DataFrame:
    """The whole table as one ordered log; log_order is that of one domain's notes."""
    x = read(spark, d, "parsed_notes").select("guid", "updated_ms", "last_seen_at").distinct()
    x = x.withColumn("pos", F.struct("guid", "updated_ms", "last_seen_at"))
    return integrity.log_order(x, "pos", "last_seen_at").select("guid", "updated_ms", "problem")


_PATHS = [r"^[^/]+/\d{4}年\d{2}月/", r"^README\.md$"]


@query(r"SELECT DISTINCT canonical_path AS path FROM parsed_notes WHERE canonical_path IS NOT NULL AND NOT (regexp_matches(canonical_path, '^[^/]+/\d{4}年\d{2}月/') OR regexp_matches(canonical_path, '^README\.md$'))")
def paths_outside(spark: SparkSession, d: str) -> DataFrame:
    """Paths that no allowed pattern covers."""
    return integrity.allowed_paths(read(spark, d, "parsed_notes").where("canonical_path is not null").select(F.col("canonical_path").alias("path")).distinct(), _PATHS)


@query(rf"""WITH d AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL), m AS (SELECT DISTINCT canonical_path AS path FROM parsed_notes WHERE outcome = 'accepted' AND canonical_path IS NOT NULL),
t AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL AND source IN ('legacy_vault', 'book_excerpt')), a AS (SELECT path FROM m UNION SELECT path FROM t)
SELECT 'unknown_path' AS kind, CAST(NULL AS VARCHAR) AS domain, path, 'unknown_path' AS detail FROM a WHERE path NOT IN (SELECT path FROM d)
UNION ALL SELECT 'moved_and_trashed', NULL, path, 'moved_and_trashed' FROM m WHERE path IN (SELECT path FROM t)
UNION ALL SELECT 'invalid_path', NULL, path, 'invalid_path' FROM a WHERE NOT regexp_matches(path, '{integrity.MONTH_PATH}')""")
def review_problems(spark: SparkSession, d: str) -> DataFrame:
    """A review's moves and trash (here from the catalog and two sources) against the stored documents."""
    moves = read(spark, d, "parsed_notes").where("outcome = 'accepted' and canonical_path is not null").select(F.col("canonical_path").alias("path"), F.lit("x").alias("domain")).dropDuplicates(["path"])
    have = docs(spark, d).where("path is not null")
    return integrity.decision_problems(moves, have.where(F.col("source").isin("legacy_vault", "book_excerpt")).select("path").distinct(), have.select("path"))


@query("""SELECT domain, strftime(created, '%Y年%m月') AS month, string_agg('- [[' || path || '|' || title || ']]', chr(10) ORDER BY created DESC, title, path) AS lines, count(*) AS n
FROM documents WHERE domain IS NOT NULL AND path IS NOT NULL AND created IS NOT NULL GROUP BY 1, 2""")
def month_indexes(spark: SparkSession, d: str) -> DataFrame:
    """The index text of each month of a domain, newest first."""
    return index.render(docs(spark, d).select("domain", "title", "path", "created", F.lit("").alias("summary")))
