"""Queries of scans, ranges, merging and ranking of search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import dedup
from quillmill.operators.integrity import LOOSE_MONTH_PATH, MONTH_PATH
from quillmill.plans.base import query, read


def hits(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "search_hits")


@query("""
SELECT search_keyword, count(*) AS pulled, count(DISTINCT page_no) AS pages, max(page_no) AS last_page,
       count(DISTINCT page_no) = max(page_no) AS complete
FROM search_hits GROUP BY search_keyword""")
def scan_complete(spark: SparkSession, d: str) -> DataFrame:
    """Exhaustive scan: a keyword is complete if no page is missing."""
    pages = F.count_distinct("page_no")
    return hits(spark, d).groupBy("search_keyword").agg(
        F.count("*").alias("pulled"), pages.alias("pages"), F.max("page_no").alias("last_page"), (pages == F.max("page_no")).alias("complete")
    )


@query("""
SELECT guid, updated, created, (SELECT count(DISTINCT guid) FROM search_hits) AS total
FROM (SELECT guid, max(updated) AS updated, max(created) AS created FROM search_hits GROUP BY guid)
ORDER BY updated DESC, created DESC, guid DESC LIMIT 250""")
def scan_capped(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the freshest notes, with the server's total."""
    notes = hits(spark, d).groupBy("guid").agg(F.max("updated").alias("updated"), F.max("created").alias("created"))
    total = notes.agg(F.count("*").alias("total"))  # one row
    return notes.orderBy(F.desc("updated"), F.desc("created"), F.desc("guid")).limit(250).crossJoin(F.broadcast(total))


@query("""
SELECT coalesce(n.name, '未知笔记本') AS notebook, count(*) AS hits, count(DISTINCT h.guid) AS notes
FROM search_hits h LEFT JOIN notebooks n ON h.notebook_guid = n.guid GROUP BY 1""")
def notebook_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits and notes of each notebook; the name comes after the aggregation, so a hot notebook is one row by then."""
    by_guid = hits(spark, d).select("notebook_guid", "guid").groupBy("notebook_guid", "guid").agg(F.count("*").alias("n"))
    by_guid = by_guid.groupBy("notebook_guid").agg(F.sum("n").alias("hits"), F.count("*").alias("notes"), F.lit(1).alias("one"))
    names = read(spark, d, "notebooks").select(F.col("guid").alias("notebook_guid"), "name")
    named = by_guid.join(names, "notebook_guid", "left").withColumn("notebook", F.coalesce("name", F.lit("未知笔记本")))
    return named.groupBy("notebook").agg(F.sum("hits").alias("hits"), F.sum("notes").alias("notes"))


@query("""SELECT guid, name, row_number() OVER (ORDER BY lower(name), guid) AS place FROM notebooks""")
def notebooks_sorted(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy(F.lower("name"), "guid")  # a dimension of some dozens of rows
    return read(spark, d, "notebooks").select("guid", "name", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT guid, max(content_length) AS content_length FROM search_hits WHERE coalesce(content_length, 0) > 4000 GROUP BY guid""")
def large_notes(spark: SparkSession, d: str) -> DataFrame:
    """A predicate on a column that can be null, like the scan of deleted notes; it reaches the Parquet scan."""
    return hits(spark, d).where(F.col("content_length") > 4000).groupBy("guid").agg(F.max("content_length").alias("content_length"))


@query("""
SELECT guid, count(*) AS hits FROM search_hits
WHERE created >= epoch_ms(TIMESTAMP '2024-01-01 00:00:00') - 8 * 3600000 AND created < epoch_ms(TIMESTAMP '2024-07-01 00:00:00') - 8 * 3600000
GROUP BY guid""")
def created_range(spark: SparkSession, d: str) -> DataFrame:
    """Half-open range of local days, as constants in the time of the column, so that it is pushed down."""
    from datetime import datetime, timedelta, timezone

    local = timezone(timedelta(hours=8))
    since, until = (int(datetime(2024, m, 1, tzinfo=local).timestamp() * 1000) for m in (1, 7))
    return hits(spark, d).where((F.col("created") >= since) & (F.col("created") < until)).groupBy("guid").agg(F.count("*").alias("hits"))


def parse_query(text: str):
    """A predicate on (title, created ms) from the small query language.

    'intitle:x' or '标题:x' tests the title, 'created:2024-01-31' or '创建时间:…' a first day (UTC), 'any:' in front joins by or; other
    words are looked for in the title. Case does not count. An empty query matches everything.
    """
    from datetime import datetime, timezone

    words = text.replace("：", ":").split()
    either = bool(words) and words[0].lower() == "any:"
    tests = []
    for w in words[either:]:
        head, _, rest = w.partition(":")
        if head in ("intitle", "标题") and rest:
            tests.append(F.lower("title").contains(rest.lower()))
        elif head in ("created", "创建时间") and rest:
            day = datetime.strptime(rest, "%Y-%m-%d").replace(tzinfo=timezone.utc)
            tests.append(F.col("created") >= int(day.timestamp() * 1000))
        else:
            tests.append(F.lower("title").contains(w.lower()))
    out = F.lit(not (either and tests))
    for t in tests:
        out = (out | t) if either else (out & t)
    return out


@query("""
SELECT DISTINCT guid, title FROM search_hits
WHERE contains(lower(title), 'vol') AND created >= epoch_ms(TIMESTAMP '2024-06-01 00:00:00')""")
def query_all(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).where(parse_query("标题：Vol created:2024-06-01")).select("guid", "title").distinct()


@query("""
SELECT DISTINCT guid, title FROM search_hits WHERE contains(lower(title), '周报') OR contains(lower(title), 'weekly') OR contains(lower(title), 'memo')""")
def query_any(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).where(parse_query("any: 周报 intitle:weekly memo")).select("guid", "title").distinct()


@query(rf"""SELECT doc_id, split_part(path, '/', 2) AS month FROM documents
WHERE regexp_matches(path, '{MONTH_PATH}') AND type = '资料' AND domain = split_part(path, '/', 1)""")
def stored_materials(spark: SparkSession, d: str) -> DataFrame:
    """Documents in a month folder of their own domain."""
    docs = read(spark, d, "documents").where((F.col("type") == "资料") & F.col("path").rlike(MONTH_PATH))
    return docs.where(F.col("domain") == F.split_part("path", F.lit("/"), F.lit(1))).select("doc_id", F.split_part("path", F.lit("/"), F.lit(2)).alias("month"))


@query(rf"""SELECT split_part(path, '/', 1) AS folder, split_part(path, '/', 2) AS month, count(*) AS docs FROM documents
WHERE regexp_matches(path, '{LOOSE_MONTH_PATH}') GROUP BY 1, 2""")
def month_folders(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where(F.col("path").rlike(LOOSE_MONTH_PATH))
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i))
    return docs.groupBy(part(1).alias("folder"), part(2).alias("month")).agg(F.count("*").alias("docs"))


@query("""SELECT source_guid AS guid, CAST(max(epoch(updated)) AS BIGINT) AS version FROM documents WHERE source_guid IS NOT NULL AND updated IS NOT NULL GROUP BY 1""")
def local_versions(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("source_guid is not null and updated is not null")
    return docs.groupBy(F.col("source_guid").alias("guid")).agg(F.max(F.unix_seconds(F.col("updated").cast("timestamp"))).alias("version"))


@query("""SELECT strftime(created, '%Y年%m月') AS month, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def month_buckets(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(T.month_folder(F.col("created")).alias("month"), "n_chars")
    return docs.groupBy("month").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


# ---- merging and ranking


@query("""
SELECT guid, title, created, updated FROM (
  SELECT *, row_number() OVER (PARTITION BY guid ORDER BY updated DESC, created DESC, title DESC) AS r FROM search_hits) WHERE r = 1""")
def guid_merge(spark: SparkSession, d: str) -> DataFrame:
    return dedup.freshest(hits(spark, d).select("guid", "title", "created", "updated"), ["guid"], ["updated", "created", "title"])


WORDS = ["大模型", "针灸", "Weekly"]
RANKED = """
merged AS (SELECT guid, title, created, updated,
    contains(lower(title), '大模型') OR contains(lower(title), '针灸') OR contains(lower(title), 'weekly') AS in_title
  FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY updated DESC, created DESC, title DESC) AS r FROM search_hits) WHERE r = 1),
titled AS (SELECT guid, STRIP(title) AS title, created, updated, in_title FROM merged),
uniq AS (SELECT guid, title, created, updated, in_title FROM (
    SELECT *, row_number() OVER (PARTITION BY title ORDER BY updated DESC, created DESC, guid DESC) AS r FROM titled) WHERE r = 1)"""


@query(f"""WITH {RANKED} SELECT guid, in_title, row_number() OVER (ORDER BY in_title DESC, updated DESC, created DESC, guid DESC) AS place
FROM merged ORDER BY place LIMIT 1000""")
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The thousand first in rank; places are numbered after the top-k, over its rows only."""
    order = [F.desc("in_title"), F.desc("updated"), F.desc("created"), F.desc("guid")]
    top = dedup.rank_candidates(hits(spark, d), WORDS).orderBy(*order).limit(1000)
    return top.select("guid", "in_title", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query(f"""WITH {RANKED} SELECT guid, in_title, row_number() OVER (ORDER BY in_title DESC, updated DESC, created DESC, guid DESC) AS place FROM merged""")
def rank_candidates_all(spark: SparkSession, d: str) -> DataFrame:
    """All candidates in rank; rank_candidates is the first thousand of them."""
    return dedup.places(dedup.rank_candidates(hits(spark, d), WORDS)).select("guid", "in_title", "place")


@query(f"WITH {RANKED} SELECT guid, title, created, updated FROM uniq")
def title_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_title(dedup.rank_candidates(hits(spark, d), WORDS)).select("guid", "title", "created", "updated")


@query(f"WITH {RANKED} SELECT guid, title FROM uniq ORDER BY in_title DESC, updated DESC, created DESC, guid DESC LIMIT 100")
def top_titles(spark: SparkSession, d: str) -> DataFrame:
    return dedup.top_titles(dedup.rank_candidates(hits(spark, d), WORDS), 100).select("guid", "title")


@query(f"""WITH {RANKED}, passed AS (SELECT * FROM titled WHERE guid IN (SELECT guid FROM parsed_notes WHERE outcome = 'accepted')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY updated DESC, created DESC, guid DESC) AS r FROM passed) WHERE r = 1)
SELECT guid, title FROM best ORDER BY in_title DESC, updated DESC, created DESC, guid DESC LIMIT 100""")
def gate_dedup_limit(spark: SparkSession, d: str) -> DataFrame:
    """Gate, then titles, then the limit."""
    passed = read(spark, d, "parsed_notes").where("outcome = 'accepted'").select("guid")
    return dedup.gate_then_dedup(dedup.rank_candidates(hits(spark, d), WORDS), passed, 100).select("guid", "title")


NOTES = """notes AS (SELECT guid, title, updated, created, ok FROM (
  SELECT guid, title, updated_ms AS updated, created_ms AS created, outcome = 'accepted' AS ok,
    row_number() OVER (PARTITION BY guid ORDER BY updated_ms DESC, created_ms DESC, title DESC, outcome DESC) AS r FROM parsed_notes) WHERE r = 1)"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each parsed note: guid, title, updated, created, ok."""
    rows = read(spark, d, "parsed_notes").select("guid", "title", F.col("updated_ms").alias("updated"), F.col("created_ms").alias("created"), "outcome")
    best = dedup.freshest(rows, ["guid"], ["updated", "created", "title", "outcome"])
    return best.select("guid", "title", "updated", "created", (F.col("outcome") == "accepted").alias("ok"))


@query(f"""WITH {NOTES} SELECT guid, CASE WHEN NOT ok THEN 'rejected'
  WHEN row_number() OVER (PARTITION BY STRIP(title), ok ORDER BY updated DESC, created DESC, guid DESC) = 1 THEN 'accepted' ELSE 'duplicate_title' END AS outcome
FROM notes""")
def claim_titles(spark: SparkSession, d: str) -> DataFrame:
    """In freshness order the first accepted note of a title claims it; rejected ones don't."""
    return dedup.claim_titles(notes(spark, d), F.col("ok")).select("guid", "outcome")


@query(f"""WITH {NOTES}, o AS (SELECT guid, CASE WHEN NOT ok THEN 'rejected'
  WHEN row_number() OVER (PARTITION BY STRIP(title), ok ORDER BY updated DESC, created DESC, guid DESC) = 1 THEN 'accepted' ELSE 'duplicate_title' END AS outcome FROM notes)
SELECT count(*) AS notes, count_if(outcome = 'accepted') AS accepted, count_if(outcome = 'rejected') AS rejected, count_if(outcome = 'duplicate_title') AS duplicates,
  count_if(outcome IN ('accepted', 'rejected', 'duplicate_title')) = count(DISTINCT guid) AS adds_up FROM o""")
def accounting(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes add up to the unique notes."""
    o = dedup.claim_titles(notes(spark, d), F.col("ok"))
    count = lambda name: F.count_if(F.col("outcome") == name)
    return o.agg(
        F.count("*").alias("notes"), count("accepted").alias("accepted"), count("rejected").alias("rejected"), count("duplicate_title").alias("duplicates"),
        (count("accepted") + count("rejected") + count("duplicate_title") == F.count_distinct("guid")).alias("adds_up"),
    )


@query("""
SELECT title, guid, updated, created FROM (SELECT STRIP(title) AS title, source_guid AS guid, epoch_ms(updated) AS updated, epoch_ms(created) AS created,
  row_number() OVER (PARTITION BY STRIP(title) ORDER BY updated DESC, created DESC, source_guid DESC) AS r
  FROM documents WHERE source_guid IS NOT NULL AND updated IS NOT NULL AND STRIP(title) <> '') WHERE r = 1""")
def title_owners(spark: SparkSession, d: str) -> DataFrame:
    from quillmill.operators.incremental import owners

    o = owners(stored(spark, d).where("guid is not null and updated is not null"))
    return o.select("title", "owner.guid", "owner.updated", "owner.created")


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents with times in ms: doc_id, guid, title, path, domain, updated, created."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).alias(c)
    return read(spark, d, "documents").select("doc_id", F.col("source_guid").alias("guid"), "title", "path", "domain", ms("updated"), ms("created"))


@query(r"""
WITH x AS (SELECT doc_id, domain, STRIP(title) AS title,
  row_number() OVER (PARTITION BY domain, STRIP(title) ORDER BY updated DESC NULLS LAST, created DESC NULLS LAST, source_guid DESC NULLS LAST, doc_id DESC) AS r,
  count(*) OVER (PARTITION BY domain, STRIP(title)) AS copies FROM documents)
SELECT doc_id, r = 1 AS winner, copies, CASE WHEN r = 1 AND copies > 1 THEN regexp_replace(title, '[<>:"/\\|?*]', '_', 'g') END AS new_name FROM x""")
def archived_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Winner and canonical name of each (domain, title)."""
    w = Window.partitionBy("domain", T.strip(F.col("title")))
    rank = F.row_number().over(w.orderBy(F.desc_nulls_last("updated"), F.desc_nulls_last("created"), F.desc_nulls_last("guid"), F.desc("doc_id")))
    x = stored(spark, d).withColumns({"winner": rank == 1, "copies": F.count("*").over(w)})
    name = F.regexp_replace(T.strip(F.col("title")), r'[<>:"/\\|?*]', "_")
    return x.select("doc_id", "winner", "copies", F.when(F.col("winner") & (F.col("copies") > 1), name).alias("new_name"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY notebook_guid ORDER BY created DESC, doc_id DESC) <= 5 AS keep FROM documents""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    """The five newest of each notebook are kept."""
    return dedup.keep_newest(read(spark, d, "documents"), 5, ["notebook_guid"], "created", "doc_id").select("doc_id", "keep")
