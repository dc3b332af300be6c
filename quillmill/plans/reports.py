"""Queries of reports, plans and rewrites. Their SQL takes in that of the checks they put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import incremental, integrity, keywords, links, reports, scoring
from quillmill.operators.registry import SAMPLE
from quillmill.plans import audits, joins, matching, texts
from quillmill.plans.base import QUERIES, SQL, query, read


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


# ---- scans


@query("""SELECT guid, search_keyword, title, updated FROM search_hits WHERE notebook_guid = (SELECT min(guid) FROM notebooks) AND coalesce(content_length, 0) > 0""")
def notebook_active(spark: SparkSession, d: str) -> DataFrame:
    """The active notes of one notebook; the tables mark no deletion, so a length stands for being active."""
    one = read(spark, d, "notebooks").agg(F.min("guid").alias("notebook_guid"))
    active = read(spark, d, "search_hits").where(F.coalesce("content_length", F.lit(0)) > 0)
    return active.join(F.broadcast(one), "notebook_guid", "left_semi").select("guid", "search_keyword", "title", "updated")


@query("""SELECT guid, search_keyword, page_no, pulled_at FROM search_hits WHERE content_length IS NULL ORDER BY pulled_at DESC, guid, search_keyword, page_no LIMIT 100""")
def deleted_notes(spark: SparkSession, d: str) -> DataFrame:
    """The latest 100 deleted notes (a missing length stands for it): a top-k."""
    gone = read(spark, d, "search_hits").where("content_length is null").select("guid", "search_keyword", "page_no", "pulled_at")
    return gone.orderBy(F.desc("pulled_at"), "guid", "search_keyword", "page_no").limit(100)


@query("""SELECT source_guid AS guid, max({'u': updated, 'p': path}).p AS path, count(*) AS copies FROM documents WHERE source_guid IS NOT NULL AND path IS NOT NULL AND updated IS NOT NULL GROUP BY 1""")
def last_writers(spark: SparkSession, d: str) -> DataFrame:
    """For each note the stored file that was written last."""
    have = docs(spark, d).where("source_guid is not null and path is not null and updated is not null")
    return have.groupBy(F.col("source_guid").alias("guid")).agg(F.max(F.struct("updated", "path"))["path"].alias("path"), F.count("*").alias("copies"))


@query("SELECT doc_id, sha256(text) AS sha, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL")
def raw_bodies(spark: SparkSession, d: str) -> DataFrame:
    """What a raw download writes: the text unchanged, by hash and bytes."""
    return docs(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"))


@query("""WITH n AS (SELECT search_keyword, max(pulled_at) AS newest FROM search_hits GROUP BY 1)
SELECT h.search_keyword, h.page_no, count(*) AS n FROM search_hits h JOIN n ON h.search_keyword = n.search_keyword WHERE h.pulled_at < n.newest - INTERVAL 30 DAY GROUP BY 1, 2""")
def prune_pulls(spark: SparkSession, d: str) -> DataFrame:
    """Pulls over 30 days older than the newest of their keyword: what a prune of old snapshots removes."""
    hits = read(spark, d, "search_hits")
    newest = hits.groupBy("search_keyword").agg(F.max("pulled_at").alias("newest"))
    return hits.join(newest, "search_keyword").where("pulled_at < newest - interval 30 days").groupBy("search_keyword", "page_no").agg(F.count("*").alias("n"))


# ---- joins and sets


@query("""SELECT k.guid, k.updated_ms, k.selection_hash, count(*) AS n, min(k.outcome) AS outcome FROM (SELECT DISTINCT guid, updated_ms FROM parsed_notes) c
JOIN keyword_analyses k ON c.guid = k.guid AND c.updated_ms = k.updated_ms WHERE k.selection_hash = (SELECT min(selection_hash) FROM keyword_analyses) GROUP BY 1, 2, 3""")
def keyword_cache_exact(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of one selection against the keyword catalog, by guid, version and selection."""
    cache = read(spark, d, "keyword_analyses").select("guid", "updated_ms", "selection_hash", "outcome")
    one = cache.agg(F.min("selection_hash").alias("selection_hash"))
    wanted = read(spark, d, "parsed_notes").select("guid", "updated_ms").distinct().crossJoin(F.broadcast(one))  # one row
    key = ["guid", "updated_ms", "selection_hash"]
    return wanted.join(cache, key).groupBy(*key).agg(F.count("*").alias("n"), F.min("outcome").alias("outcome"))


@query("""WITH m AS (SELECT canonical_path AS path, min(lower(body_sha256)) AS sha FROM parsed_notes WHERE outcome = 'accepted' AND canonical_path IS NOT NULL GROUP BY 1),
a AS (SELECT path, min(p.sha) AS sha FROM documents d LEFT JOIN (SELECT guid, min(lower(body_sha256)) AS sha FROM parsed_notes GROUP BY 1) p ON d.source_guid = p.guid WHERE path IS NOT NULL GROUP BY 1),
f AS (SELECT canonical_path AS path, min(lower(body_sha256)) AS sha FROM keyword_analyses WHERE canonical_path IS NOT NULL GROUP BY 1)
SELECT coalesce(m.path, a.path, f.path) AS path, CASE WHEN m.path IS NULL THEN 'not_in_manifest' WHEN a.path IS NULL THEN 'not_in_archive' WHEN f.path IS NULL THEN 'no_file'
  WHEN m.sha IS DISTINCT FROM f.sha OR m.sha IS DISTINCT FROM a.sha THEN 'sha_differs' ELSE 'same' END AS status
FROM m FULL JOIN a ON m.path = a.path FULL JOIN f ON coalesce(m.path, a.path) = f.path""")
def archive_consistency(spark: SparkSession, d: str) -> DataFrame:
    """The catalog as manifest, the stored documents as archive and the keyword catalog as files, by path and hash."""
    state = lambda t: t.where("path is not null").groupBy("path").agg(F.min("sha").alias("sha"))
    of = lambda t: read(spark, d, t).select(F.col("canonical_path").alias("path"), F.lower("body_sha256").alias("sha"), "outcome", "guid")
    bodies = of("parsed_notes").groupBy("guid").agg(F.min("sha").alias("sha"))
    archive = docs(spark, d).select("path", F.col("source_guid").alias("guid")).join(bodies, "guid", "left")
    return reports.three_way(state(of("parsed_notes").where("outcome = 'accepted'")), state(archive), state(of("keyword_analyses")))


@query(f"""WITH j(domain, place) AS (VALUES {", ".join(f"('{n}', {i + 1})" for i, n in enumerate(matching.JOB))}), t AS (SELECT DISTINCT split_part(path, '/', 1) AS domain FROM documents WHERE contains(path, '/'))
SELECT * FROM j UNION ALL SELECT domain, row_number() OVER (ORDER BY domain) + (SELECT count(*) FROM j) FROM t WHERE domain NOT IN (SELECT domain FROM j)""")
def known_domains(spark: SparkSession, d: str) -> DataFrame:
    return reports.known_domains(list(matching.JOB), docs(spark, d).select("path"))


# ---- analysis and roll-ups


@query(f"""WITH {matching.GATE}, g AS (SELECT id, string_agg(domain || '=' || score, ',' ORDER BY ord) AS scores, string_agg(domain || ':' || evidence, ';' ORDER BY ord) AS evidence,
  coalesce(string_agg(domain, ',' ORDER BY ord) FILTER (eligible), '') AS labels FROM scores GROUP BY 1), v AS (SELECT doc_id, {texts.VISIBLE} AS v FROM documents)
SELECT v.doc_id, length(v) AS body_chars, coalesce(scores, '') AS scores, coalesce(evidence, '') AS evidence, coalesce(labels, '') AS labels,
  CASE WHEN length(v) > 360 THEN regexp_replace(substr(v, 1, 360), '[，,；;。 ]+$', '') || '……' ELSE v END AS summary FROM v LEFT JOIN g ON v.doc_id = g.id""")
def analysis_rows(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis of each document: body, scores and evidence by domain, eligible domains, summary."""
    rows = scoring.analyses(docs(spark, d).select(F.col("doc_id").alias("id"), T.visible_text(F.col("text")).alias("body")), matching.gate(spark, d))
    text = lambda m, sep, joint: F.array_join(F.transform(m, lambda x: F.concat(x["domain"], F.lit(sep), x["value"].cast("string"))), joint)
    return rows.select(
        F.col("id").alias("doc_id"), F.length("body").cast("long").alias("body_chars"), text(F.col("scores"), "=", ",").alias("scores"), text(F.col("evidence"), ":", ";").alias("evidence"),
        F.array_join("labels", ",").alias("labels"), T.cache_summary(F.col("body")).alias("summary"),
    )


@query("""SELECT STRIP(title) AS title, count(DISTINCT domain) AS domains, coalesce(string_agg(DISTINCT path, '|' ORDER BY path), '') AS paths FROM documents
WHERE domain IS NOT NULL AND STRIP(title) <> '' GROUP BY 1 HAVING count(DISTINCT domain) > 1""")
def titles_across(spark: SparkSession, d: str) -> DataFrame:
    """Titles that stand in several domains, with all their paths."""
    have = docs(spark, d).where("domain is not null").select(T.strip(F.col("title")).alias("title"), "domain", "path").where("title <> ''").distinct()
    wide = have.groupBy("title").agg(F.min("domain").alias("a"), F.max("domain").alias("b")).where("a <> b").select("title")
    groups = have.join(wide, "title", "left_semi").groupBy("title").agg(F.count_distinct("domain").alias("domains"), F.array_join(F.array_sort(F.collect_set("path")), "|").alias("paths"))
    return groups


_ALIASED = f"x(domain, di, keyword, ki, term) AS (VALUES {matching._values(matching._HITS)})"


@query(f"""WITH {_ALIASED}, h AS (SELECT search_keyword, count(*) AS hits, count(DISTINCT guid) AS notes FROM search_hits GROUP BY 1)
SELECT x.domain, x.keyword, CAST(sum(coalesce(h.hits, 0)) AS BIGINT) AS hits, string_agg(x.term || ':' || coalesce(h.notes, 0), ',' ORDER BY x.term) AS terms FROM x LEFT JOIN h ON x.term = h.search_keyword GROUP BY 1, 2""")
def keyword_totals(spark: SparkSession, d: str) -> DataFrame:
    """Hits rolled up from the terms searched for to their canonical keyword."""
    terms = keywords.expanded_frame(spark, matching.JOB, matching.ALIASES).select("domain", "keyword", "term")
    hits = read(spark, d, "search_hits").groupBy(F.col("search_keyword").alias("term")).agg(F.count("*").alias("hits"), F.count_distinct("guid").alias("notes"))
    j = terms.join(hits, "term", "left").na.fill(0, ["hits", "notes"])
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "notes"))), lambda x: F.concat(x["term"], F.lit(":"), x["notes"].cast("string"))), ",")
    return j.groupBy("domain", "keyword").agg(F.sum("hits").alias("hits"), said.alias("terms"))


@query(f"""WITH {_ALIASED} SELECT guid, string_agg(DISTINCT x.domain || '/' || x.keyword, ',' ORDER BY x.domain || '/' || x.keyword) AS found FROM search_hits h JOIN x ON h.search_keyword = x.term GROUP BY 1""")
def keyword_domains_of_note(spark: SparkSession, d: str) -> DataFrame:
    """The domains and canonical keywords that found each note."""
    terms = keywords.expanded_frame(spark, matching.JOB, matching.ALIASES).select("domain", "keyword", F.col("term").alias("search_keyword"))
    pairs = read(spark, d, "search_hits").select("guid", "search_keyword").distinct().join(terms, "search_keyword").select("guid", F.concat_ws("/", "domain", "keyword").alias("k"))
    return pairs.groupBy("guid").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("found"))


@query(f"SELECT change, count(*) AS objects, CAST(sum(coalesce(after_size, 0)) AS BIGINT) AS after_size, CAST(sum(coalesce(before_size, 0)) AS BIGINT) AS before_size FROM ({SQL['changed_paths']}) GROUP BY 1")
def change_summary(spark: SparkSession, d: str) -> DataFrame:
    """Objects and sizes of a transaction by kind of change."""
    size = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return joins.changed_paths(spark, d).groupBy("change").agg(F.count("*").alias("objects"), size("after_size"), size("before_size"))


@query(f"""WITH {audits._PAIRS}, e AS (SELECT DISTINCT path AS a, nxt AS b FROM n WHERE nxt IS NOT NULL AND nxt <> path)
SELECT (SELECT count(*) FROM documents WHERE path IS NOT NULL AND source IS DISTINCT FROM 'legacy_vault') AS keep, (SELECT count(*) FROM documents WHERE path IS NOT NULL AND source = 'legacy_vault') AS trash,
  (SELECT count(*) FROM (SELECT DISTINCT least(a, b), greatest(a, b) FROM e)) AS edges""")
def curation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents kept and trashed, and links between documents, each counted once."""
    have = docs(spark, d).where("path is not null")
    old = F.coalesce(F.col("source") == "legacy_vault", F.lit(False))
    counts = have.agg(F.count_if(~old).alias("keep"), F.count_if(old).alias("trash"))
    e = audits._links(spark, d).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return counts.crossJoin(e.agg(F.count("*").alias("edges")))  # one row each


@query("""WITH o AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', {i})" for i, n in enumerate(SAMPLE.names)) + """) AS o(domain, ord)),
x AS (SELECT coalesce(o.ord, 99) AS ord, path, coalesce(max(strftime(updated, '%Y-%m-%d %H:%M:%S')), '') AS u FROM documents d LEFT JOIN o ON d.domain = o.domain WHERE path IS NOT NULL GROUP BY 1, 2)
SELECT path, u AS updated, row_number() OVER (ORDER BY ord, u DESC, path DESC) AS place FROM x""")
def catalog_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the order of a catalog: the registry's domains, within one the last updated first."""
    places = spark.createDataFrame(list(enumerate(SAMPLE.names)), "ord int, domain string")
    x = docs(spark, d).where("path is not null").join(F.broadcast(places), "domain", "left")
    x = x.groupBy(F.coalesce("ord", F.lit(99)).alias("ord"), "path").agg(F.coalesce(F.max(F.date_format("updated", "yyyy-MM-dd HH:mm:ss")), F.lit("")).alias("updated"))
    return reports.numbered(x, F.col("ord"), F.desc("updated"), F.desc("path")).select("path", "updated", "place")


# ---- checks put together

_UNION = lambda parts: " UNION ALL ".join(f"SELECT {k} AS kind, domain, path, CAST(detail AS VARCHAR) AS detail FROM ({s})" for k, s in parts)
_INTEGRITY = _UNION([("kind", SQL[n]) for n in ("integrity_issues", "missing_attachments", "index_drift")])


def _integrity(spark: SparkSession, d: str) -> DataFrame:
    return audits.integrity_issues(spark, d).unionByName(audits.missing_attachments(spark, d)).unionByName(audits.index_drift(spark, d))


@query(_INTEGRITY)
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is wrong with stored documents and their indexes."""
    return _integrity(spark, d)


@query(f"""WITH a AS (SELECT domain, count(*) AS articles FROM documents WHERE path IS NOT NULL GROUP BY 1), i AS (SELECT domain, count(*) AS issues FROM ({_INTEGRITY}) GROUP BY 1)
SELECT coalesce(a.domain, i.domain) AS domain, coalesce(articles, 0) AS articles, coalesce(issues, 0) AS issues FROM a FULL JOIN i ON a.domain IS NOT DISTINCT FROM i.domain""")
def integrity_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.totals(docs(spark, d).where("path is not null"), _integrity(spark, d))


_LINT = _UNION(
    [
        ("'MISSING_SCHEMA'", "SELECT NULL AS domain, 'README.md' AS path, 'README.md' AS detail WHERE NOT EXISTS (SELECT 1 FROM documents WHERE path = 'README.md')"),
        ("'MISSING_REQUIRED_DIRECTORY'", f"SELECT domain, NULL AS path, domain AS detail FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in [*SAMPLE.names, '附录'])}) AS r(domain) WHERE domain NOT IN (SELECT split_part(path, '/', 1) FROM documents WHERE path IS NOT NULL)"),
        ("'INVALID_FRONTMATTER'", "SELECT domain, path, 'header' AS detail FROM documents WHERE text IS NULL OR NOT starts_with(text, '---')"),
        ("kind", SQL["lint_properties"]),
        ("CASE reason WHEN 'ambiguous' THEN 'AMBIGUOUS_WIKILINK' ELSE 'BROKEN_WIKILINK' END", f"SELECT d.domain, d.path, r.target AS detail, r.reason FROM ({SQL['reference_resolution']}) r JOIN documents d USING (doc_id) WHERE r.reason IN ('ambiguous', 'missing', 'outside')"),
        ("CASE n WHEN 0 THEN 'MISSING_SOURCE' ELSE 'INSUFFICIENT_COMPARISON_SOURCES' END", f"SELECT split_part(path, '/', 1) AS domain, path, n AS detail, n FROM ({SQL['few_sources']})"),
        ("'ORPHAN_KNOWLEDGE_NOTE'", f"SELECT DISTINCT split_part(o.path, '/', 1) AS domain, o.path, d.type AS detail FROM ({SQL['orphan_documents']}) o JOIN documents d ON o.path = d.path WHERE d.type = '知识'"),
        ("'INVALID_AUTO_REGION'", f"SELECT d.domain, d.path, r.doc_id AS detail FROM ({SQL['regions_valid']}) r JOIN documents d USING (doc_id) WHERE contains(d.text, '## ') AND NOT r.valid"),
        ("'INDEX_DRIFT'", SQL["index_drift"]),
        ("'INVALID_LOG_ENTRY'", f"SELECT NULL AS domain, guid AS path, problem AS detail FROM ({SQL['log_order_all']}) WHERE problem IN ('unreadable', 'goes_back')"),
    ]
)


def _lint(spark: SparkSession, d: str) -> DataFrame:
    have = docs(spark, d)
    paths = have.select("path").where("path is not null")
    no = F.lit(None).cast("string")
    schema = spark.range(1).join(paths.where("path = 'README.md'").limit(1), how="left_anti").select(no.alias("domain"), F.lit("README.md").alias("path"))
    tops = paths.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("domain")).distinct()
    required = spark.createDataFrame([(n,) for n in [*SAMPLE.names, "附录"]], "domain string").join(tops, "domain", "left_anti").withColumn("path", no)
    about = have.select("doc_id", "domain", "path", "type", "text")
    refs = audits.reference_resolution(spark, d).where(F.col("reason").isin("ambiguous", "missing", "outside")).join(about.drop("text"), "doc_id")
    few = audits.few_sources(spark, d).withColumn("domain", F.split_part("path", F.lit("/"), F.lit(1)))
    orphans = audits.orphan_documents(spark, d).join(about.where("type = '知识'").select("path", "type").distinct(), "path").withColumn("domain", F.split_part("path", F.lit("/"), F.lit(1)))
    regions = audits.regions_valid(spark, d).where("not valid").join(about.where(F.contains("text", F.lit("## "))), "doc_id")
    log = audits.log_order_all(spark, d).where(F.col("problem").isin("unreadable", "goes_back")).select(no.alias("domain"), F.col("guid").alias("path"), "problem")
    drift = audits.index_drift(spark, d)
    parts = [
        integrity.issues(schema, "MISSING_SCHEMA", F.col("path")),
        integrity.issues(required, "MISSING_REQUIRED_DIRECTORY", F.col("domain")),
        integrity.issues(have.where(F.col("text").isNull() | ~F.col("text").startswith("---")), "INVALID_FRONTMATTER", F.lit("header")),
        audits.lint_properties(spark, d),
        integrity.issues(refs, F.when(F.col("reason") == "ambiguous", "AMBIGUOUS_WIKILINK").otherwise("BROKEN_WIKILINK"), F.col("target")),
        integrity.issues(few, F.when(F.col("n") == 0, "MISSING_SOURCE").otherwise("INSUFFICIENT_COMPARISON_SOURCES"), F.col("n")),
        integrity.issues(orphans, "ORPHAN_KNOWLEDGE_NOTE", F.col("type")),
        integrity.issues(regions, "INVALID_AUTO_REGION", F.col("doc_id")),
        integrity.issues(drift, "INDEX_DRIFT", F.col("detail")),
        integrity.issues(log, "INVALID_LOG_ENTRY", F.col("problem")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return reports.with_severity(out)


_SEVERE = f"SELECT *, CASE WHEN kind IN ('ORPHAN_KNOWLEDGE_NOTE', 'INVALID_LOG_ENTRY') THEN 'warning' ELSE 'error' END AS severity FROM ({_LINT})"


@query(_SEVERE)
def lint_report(spark: SparkSession, d: str) -> DataFrame:
    """All checks of a vault as one report with severities."""
    return _lint(spark, d)


@query(f"SELECT count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings, count_if(severity = 'error') = 0 AS ok FROM ({_SEVERE})")
def lint_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.severities(_lint(spark, d))


@query(f"""WITH c AS (SELECT guid, max({{'u': updated_ms, 'h': selection_hash, 'o': outcome, 'p': coalesce(canonical_path, ''), 'k': coalesce(matched_keywords_json, ''), 't': coalesce(matched_terms_json, '')}}) AS c FROM keyword_analyses GROUP BY 1),
j AS (SELECT d.source_guid AS guid, d.domain, d.path, d.created, d.type, c.c FROM documents d LEFT JOIN c ON d.source_guid = c.guid WHERE d.path IS NOT NULL),
w AS (SELECT *, CASE WHEN json_valid(c.k) THEN from_json(c.k, '["VARCHAR"]') END AS ks, CASE WHEN json_valid(c.t) THEN from_json(c.t, '["VARCHAR"]') END AS ts FROM j)
SELECT unnest(list_filter([CASE WHEN NOT (created >= TIMESTAMP '2023-06-01' AND created < TIMESTAMP '2025-06-01') THEN 'out_of_range_article' END, CASE WHEN type IS DISTINCT FROM '资料' THEN 'selection_mode_mismatch' END,
  CASE WHEN c.h <> (SELECT min(selection_hash) FROM keyword_analyses) THEN 'selection_hash_mismatch' END, CASE WHEN len(list_filter(ks, lambda x: x NOT IN ({", ".join(f"'{w}'" for w in audits.ALLOWED_WORDS)}))) > 0 THEN 'matched_keywords_invalid' END,
  CASE WHEN c IS NULL THEN 'missing_keyword_cache' END, CASE WHEN c.o <> 'accepted' THEN 'unexpected_canonical_file' END, CASE WHEN c.o = 'accepted' AND c.p <> path THEN 'canonical_path_mismatch' END,
  CASE WHEN len(list_filter(ks, lambda x: NOT list_contains(ts, x))) > 0 THEN 'matched_keywords_mismatch' END], lambda x: x IS NOT NULL)) AS kind, domain, path, guid AS detail FROM w""")
def keyword_export_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents against the newest cached selection of their note: eight codes."""
    cache = read(spark, d, "keyword_analyses")
    text = lambda c: F.coalesce(c, F.lit(""))
    newest = cache.groupBy("guid").agg(F.max(F.struct(F.col("updated_ms").alias("u"), F.col("selection_hash").alias("h"), F.col("outcome").alias("o"), text("canonical_path").alias("p"), text("matched_keywords_json").alias("k"), text("matched_terms_json").alias("t"))).alias("c"))
    expected = F.broadcast(cache.agg(F.min("selection_hash").alias("expected")))  # one row
    j = docs(spark, d).where("path is not null").select(F.col("source_guid").alias("guid"), "domain", "path", "created", "type").join(newest, "guid", "left").crossJoin(expected)
    j = j.withColumns({"ks": F.from_json("c.k", "array<string>"), "ts": F.from_json("c.t", "array<string>")})
    return integrity.export_codes(j, audits.ALLOWED_WORDS, "2023-06-01", "2025-06-01", "资料")


@query(f"SELECT CASE reason WHEN 'outside' THEN 'escapes' ELSE 'missing' END AS kind, d.domain, d.path, r.target AS detail FROM ({SQL['reference_resolution']}) r JOIN documents d USING (doc_id) WHERE reason IN ('outside', 'missing')")
def local_link_issues(spark: SparkSession, d: str) -> DataFrame:
    """Local links that leave the vault or point at nothing."""
    bad = audits.reference_resolution(spark, d).where(F.col("reason").isin("outside", "missing")).join(docs(spark, d).select("doc_id", "domain", "path"), "doc_id")
    return integrity.issues(bad, F.when(F.col("reason") == "outside", "escapes").otherwise("missing"), F.col("target"))


@query(f"""SELECT a, kind, detail FROM ({SQL['link_rules']}) UNION ALL SELECT a, 'asymmetric_link', b FROM ({SQL['one_sided_links']})
UNION ALL SELECT d.path, 'duplicate_section', d.doc_id::VARCHAR FROM documents d WHERE d.path IS NOT NULL AND length(text) - length(replace(text, '## ', '')) > 6
UNION ALL SELECT d.path, 'missing_target', r.target FROM ({SQL['reference_resolution']}) r JOIN documents d USING (doc_id) WHERE d.path IS NOT NULL AND r.reason = 'missing'
UNION ALL SELECT d.path, 'invalid_target', r.target FROM ({SQL['reference_resolution']}) r JOIN documents d USING (doc_id) WHERE d.path IS NOT NULL AND r.reason = 'outside'""")
def link_issues(spark: SparkSession, d: str) -> DataFrame:
    """All rules of links at once: repeated, self, too many, one-sided, sections that repeat, invalid and missing targets."""
    have = docs(spark, d).where("path is not null").select("doc_id", "path", "text")
    sections = have.where(F.length("text") - F.length(F.replace("text", F.lit("## "), F.lit(""))) > 6).select(F.col("path").alias("a"), F.lit("duplicate_section").alias("kind"), F.col("doc_id").cast("string").alias("detail"))
    refs = audits.reference_resolution(spark, d).where(F.col("reason").isin("missing", "outside")).join(have.drop("text"), "doc_id")
    refs = refs.select(F.col("path").alias("a"), F.when(F.col("reason") == "missing", "missing_target").otherwise("invalid_target").alias("kind"), F.col("target").alias("detail"))
    sided = audits.one_sided_links(spark, d).select("a", F.lit("asymmetric_link").alias("kind"), F.col("b").alias("detail"))
    return audits.link_rules(spark, d).unionByName(sided).unionByName(sections).unionByName(refs)


@query(rf"SELECT DISTINCT canonical_path AS path, regexp_matches(canonical_path, '{integrity.MONTH_PATH}') AND split_part(canonical_path, '/', 1) IN ({audits._DOMAINS}) AND NOT contains(canonical_path, '\') AS valid FROM parsed_notes WHERE canonical_path IS NOT NULL")
def decision_paths(spark: SparkSession, d: str) -> DataFrame:
    """Whether each path of the catalog may be a decision's path."""
    paths = read(spark, d, "parsed_notes").where("canonical_path is not null").select(F.col("canonical_path").alias("path")).distinct()
    return paths.withColumn("valid", reports.valid_decision_path(F.col("path"), SAMPLE.names))


_LOCAL = r"r AS (SELECT doc_id, path, unnest(regexp_extract_all(text, '\]\((_attachments/[^)\s]+)\)', 1)) AS target FROM documents)"


def _attached(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"\]\((_attachments/[^)\s]+)\)"), F.lit(1))
    return docs(spark, d).select("doc_id", "path", F.explode(found).alias("target"))


_COMPLETE = f"{_LOCAL}, have AS (SELECT DISTINCT target FROM r WHERE path IS NOT NULL), done AS (SELECT doc_id, count(*) AS refs, bool_and(target IN (SELECT target FROM have)) AS complete FROM r GROUP BY 1)"


@query(f"WITH {_COMPLETE} SELECT * FROM done")
def attachments_complete(spark: SparkSession, d: str) -> DataFrame:
    """Whether all files that a document refers to are there; the files of stored documents are taken for those that are."""
    refs = _attached(spark, d)
    return reports.complete(refs, refs.where("path is not null").select(F.col("target").alias("path")))


@query("""WITH p AS (SELECT DISTINCT guid, canonical_path AS path, trim(primary_domain) AS domain FROM parsed_notes WHERE outcome = 'accepted' AND canonical_path IS NOT NULL)
SELECT p.guid, p.path, coalesce(bool_or(d.source_guid = p.guid AND d.domain = p.domain), false) AS is_current FROM p LEFT JOIN documents d ON p.path = d.path GROUP BY 1, 2""")
def canonical_current(spark: SparkSession, d: str) -> DataFrame:
    """Whether a note's canonical path still holds a document of that note and domain."""
    p = read(spark, d, "parsed_notes").where("outcome = 'accepted' and canonical_path is not null").select("guid", F.col("canonical_path").alias("path"), F.trim("primary_domain").alias("domain")).distinct()
    have = docs(spark, d).select("path", F.col("source_guid").alias("g"), F.col("domain").alias("m")).where("path is not null")
    return p.join(have, "path", "left").groupBy("guid", "path").agg(F.coalesce(F.bool_or((F.col("g") == F.col("guid")) & (F.col("m") == F.col("domain"))), F.lit(False)).alias("is_current"))


# ---- plans and rewrites


@query(f"""WITH {matching.PRIMARY}, {_COMPLETE} SELECT d.source_guid AS guid, p.domain, d.path FROM documents d JOIN prim p ON d.doc_id = p.id AND p.matched LEFT JOIN done ON d.doc_id = done.doc_id
WHERE d.path IS NOT NULL AND d.source_guid IS NOT NULL AND coalesce(done.complete, true) AND NOT EXISTS (SELECT 1 FROM parsed_notes n WHERE n.outcome = 'accepted' AND n.guid = d.source_guid AND trim(n.primary_domain) = p.domain)""")
def catalog_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Catalog entries made from stored documents: assessed anew, with complete attachments, where the catalog has no accepted entry of that note and domain."""
    prim = scoring.primary_domain(matching.gate(spark, d), matching.ALLOWED).where("matched").select(F.col("id").alias("doc_id"), F.col("domain").alias("found"))
    have = docs(spark, d).where("path is not null and source_guid is not null").select("doc_id", F.col("source_guid").alias("guid"), "path")
    known = read(spark, d, "parsed_notes").where("outcome = 'accepted'").select("guid", F.trim("primary_domain").alias("found"))
    bad = attachments_complete(spark, d).where("not complete").select("doc_id")
    return have.join(prim, "doc_id").join(bad, "doc_id", "left_anti").join(known, ["guid", "found"], "left_anti").select("guid", F.col("found").alias("domain"), "path")


@query(f"""WITH {audits._DOCS}, first AS (SELECT guid, min(doc_id) AS doc_id FROM d WHERE guid IS NOT NULL AND path IS NOT NULL GROUP BY 1),
now AS (SELECT x.path, sha256(x.text) AS sha, CASE WHEN p.guid IS NULL THEN 'unknown' WHEN x.doc_id <> f.doc_id THEN 'duplicate' END AS reason
  FROM documents x JOIN first f ON x.source_guid = f.guid LEFT JOIN (SELECT DISTINCT guid FROM parsed_notes) p ON x.source_guid = p.guid WHERE x.path IS NOT NULL),
before AS (SELECT x.path, sha256(x.text) AS sha, 'not selected' AS reason FROM documents x WHERE x.path IS NOT NULL AND x.source_guid IS NOT NULL AND x.source_guid NOT IN (SELECT guid FROM keyword_analyses)),
u AS (SELECT *, 0 AS run FROM before UNION ALL SELECT *, 1 FROM now WHERE reason IS NOT NULL)
SELECT path, sha, max({{'run': run, 'reason': reason}}).run AS run, max({{'run': run, 'reason': reason}}).reason AS reason FROM u GROUP BY 1, 2""")
def quarantine_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What two runs would put aside, with reason and hash, merged by path and hash; the later run counts."""
    have = docs(spark, d).where("path is not null and source_guid is not null").select("doc_id", F.col("source_guid").alias("guid"), "path", F.sha2("text", 256).alias("sha"))
    known = read(spark, d, "parsed_notes").select("guid").distinct().withColumn("known", F.lit(True))
    j = have.join(have.groupBy("guid").agg(F.min("doc_id").alias("first")), "guid").join(known, "guid", "left")
    now = j.withColumn("reason", F.when(F.col("known").isNull(), "unknown").when(F.col("doc_id") != F.col("first"), "duplicate")).where("reason is not null")
    before = have.join(read(spark, d, "keyword_analyses").select("guid"), "guid", "left_anti").withColumn("reason", F.lit("not selected"))
    return reports.latest_entries([x.select("path", "sha", "reason") for x in (before, now)], ["path", "sha"])


_ROOT = r"""x AS (SELECT doc_id, coalesce(domain, '未分类') || '/' || strftime(created, '%Y年%m月') || '/' || regexp_replace(STRIP(title), '[\x00-\x1f<>:"/\\|?*]', '_', 'g') || '.md' AS target,
  sha256(replace(text, '](_attachments/', '](../_attachments/')) AS sha FROM documents WHERE path IS NULL AND created IS NOT NULL)"""


def _root_notes(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_replace(T.strip(F.col("title")), r'[\x00-\x1f<>:"/\\|?*]', "_")
    target = F.concat(F.coalesce("domain", F.lit("未分类")), F.lit("/"), T.month_folder(F.col("created")), F.lit("/"), name, F.lit(".md"))
    text = F.replace("text", F.lit("](_attachments/"), F.lit("](../_attachments/"))
    return docs(spark, d).where("path is null and created is not null").select("doc_id", target.alias("target"), F.sha2(text, 256).alias("sha"))


@query(f"WITH {_ROOT} SELECT * FROM x")
def archive_plan(spark: SparkSession, d: str) -> DataFrame:
    """Where notes without a place go, with the hash of their text after its attachment links are rewritten."""
    return _root_notes(spark, d)


@query(f"WITH {_ROOT} SELECT target, count(*) AS docs, count(DISTINCT sha) AS versions FROM x GROUP BY 1 HAVING count(DISTINCT sha) > 1")
def destination_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Destinations at which different texts would meet."""
    return _root_notes(spark, d).groupBy("target").agg(F.count("*").alias("docs"), F.count_distinct("sha").alias("versions")).where("versions > 1")


@query(rf"""SELECT f.doc_id, f.path, f.final, sha256(regexp_replace(d.text, '(?m)\A(---\r?\n([^\r\n]*\r?\n)*?domain:)[^\r\n]*', '\1 ' || split_part(f.final, '/', 1))) AS sha
FROM ({SQL['final_paths']}) f JOIN documents d USING (doc_id) WHERE f.path <> f.final""")
def review_plan(spark: SparkSession, d: str) -> DataFrame:
    """The moves of a review as what they leave: final path, and the hash of the text with its new domain."""
    moved = joins.final_paths(spark, d).where("path <> final").join(docs(spark, d).select("doc_id", "text"), "doc_id")
    new = F.regexp_replace("text", F.lit(r"(?m)\A(---\r?\n(?:[^\r\n]*\r?\n)*?domain:)[^\r\n]*"), F.concat(F.lit("$1 "), F.split_part("final", F.lit("/"), F.lit(1))))
    return moved.select("doc_id", "path", "final", F.sha2(new, 256).alias("sha"))


RENAMES = {"Quant": "量化投资", "中医": "传统医学"}


def _renamed_sql() -> str:
    sql = "text"
    for old, new in RENAMES.items():
        sql = rf"""regexp_replace({sql}, '(?m)\A(---\r?\n([^\r\n]*\r?\n)*?domain: *["'']?){old}(["'']? *)$', '\1{new}\3')"""
        sql = rf"regexp_replace({sql}, '(\]\(|\[\[){old}/', '\1{new}/', 'g')"
    return sql


@query(f"SELECT doc_id, sha256(t) AS sha FROM (SELECT doc_id, text, {_renamed_sql()} AS t FROM documents) WHERE t <> text")
def taxonomy_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text changes when two domains get other names."""
    return docs(spark, d).select("doc_id", "text", reports.renamed(F.col("text"), RENAMES).alias("t")).where("t <> text").select("doc_id", F.sha2("t", 256).alias("sha"))


@query(rf"""SELECT path, CASE WHEN split_part(path, '/', 1) IN ({", ".join(f"'{n}'" for n in RENAMES)}) THEN 'path' ELSE 'header' END AS kind, count(*) AS n FROM documents
WHERE split_part(path, '/', 1) IN ({", ".join(f"'{n}'" for n in RENAMES)}) OR regexp_matches(text, '(?m)\A---\r?\n([^\r\n]*\r?\n)*?domain: *["'']?({"|".join(RENAMES)})["'']? *$') GROUP BY 1, 2""")
def taxonomy_left(spark: SparkSession, d: str) -> DataFrame:
    """What a check after such a change still finds under the old names, in paths and headers (here: before it)."""
    old = F.coalesce(F.split_part("path", F.lit("/"), F.lit(1)).isin(list(RENAMES)), F.lit(False))
    head = F.col("text").rlike(rf"(?m)\A---\r?\n(?:[^\r\n]*\r?\n)*?domain: *[\"']?(?:{'|'.join(RENAMES)})[\"']? *$")
    return docs(spark, d).where(old | head).groupBy("path", F.when(old, "path").otherwise("header").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {_LOCAL}, x AS (SELECT d.doc_id, d.text, list_concat(list_sort(list(DISTINCT substr(target, 14))), ['scan [' || d.doc_id || '].pdf', 'cover.PNG']) AS names FROM r JOIN documents d USING (doc_id) GROUP BY 1, 2),
y AS (SELECT doc_id, list_filter(names, lambda n: NOT contains(text, '_attachments/' || replace(url_encode(n), '+', '%20'))) AS rest FROM x)
SELECT doc_id, chr(10) || '---' || chr(10) || chr(10) || '## 附件' || chr(10) || chr(10) || array_to_string(list_transform(rest, lambda n: CASE WHEN ends_with(lower(n), '.png') THEN '!' ELSE '- ' END || '[' || replace(replace(n, '[', '\\['), ']', '\\]')
  || '](_attachments/' || replace(url_encode(n), '+', '%20') || ')'), chr(10)) AS section FROM y""".replace("\\\\", "\\"))
def attachment_sections(spark: SparkSession, d: str) -> DataFrame:
    """The list of files at a document's end: those it refers to are left out, so only two further ones (given here) come in."""
    own = _attached(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.expr("substring(target, 14)"))).alias("names"))
    x = docs(spark, d).select("doc_id", "text").join(own, "doc_id")
    more = F.array(F.concat(F.lit("scan ["), F.col("doc_id").cast("string"), F.lit("].pdf")), F.lit("cover.PNG"))
    return x.select("doc_id", reports.attachment_section(F.col("text"), F.concat("names", more)).alias("section"))


@query(f"""SELECT json_object('documents', (SELECT count(*) FROM documents), 'notes', (SELECT count(DISTINCT guid) FROM parsed_notes), 'accepted', (SELECT count(*) FROM parsed_notes WHERE outcome = 'accepted'),
  'moves', (SELECT count(*) FROM ({SQL['final_paths']}) WHERE path <> final), 'ok', (SELECT count(*) FROM ({SQL['final_paths']}) WHERE path <> final) = 0)::VARCHAR AS report""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """A run's aggregates as one JSON object; ok says whether nothing is left to do."""
    n = docs(spark, d).agg(F.count("*").alias("documents"))
    notes = read(spark, d, "parsed_notes").agg(F.count_distinct("guid").alias("notes"), F.count_if(F.col("outcome") == "accepted").alias("accepted"))
    moves = joins.final_paths(spark, d).where("path <> final").agg(F.count("*").alias("moves"))
    row = n.crossJoin(notes).crossJoin(moves).withColumn("ok", F.col("moves") == 0)  # one row each
    return row.select(F.to_json(F.struct("documents", "notes", "accepted", "moves", "ok")).alias("report"))


@query("""WITH x AS (SELECT doc_id, domain, strftime(created, '%Y年%m月') AS month, title, path, created FROM documents WHERE domain IS NOT NULL AND path IS NOT NULL AND created IS NOT NULL)
SELECT domain, month, row_number() OVER (ORDER BY domain, month, created DESC, title, path, doc_id) AS place, '- [[' || path || '|' || title || ']]' AS line FROM x""")
def month_index_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all month indexes in their order, one row each: no month is ever held in one row."""
    x = docs(spark, d).where("domain is not null and path is not null and created is not null").withColumn("month", T.month_folder(F.col("created")))
    x = x.select("doc_id", "domain", "month", "title", "path", "created")
    placed = reports.numbered(x, F.col("domain"), F.col("month"), F.desc("created"), F.col("title"), F.col("path"), F.col("doc_id"))
    return placed.select("domain", "month", "place", F.concat(F.lit("- [["), "path", F.lit("|"), "title", F.lit("]]")).alias("line"))
