"""Checks. Each is a query that gives rows (kind, domain, path, detail); no rows means all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = ["kind", "domain", "path", "detail"]
#: Folder names of months, the strict and the loose form.
MONTH_PATH = r"^[^/]+/\d{4}年(0[1-9]|1[0-2])月/[^/]+\.md$"
LOOSE_MONTH_PATH = r"^[^/]+/\d{4}年\d{2}月/[^/]+\.md$"


def issues(df: DataFrame, kind: str | Column, detail: Column, domain: str = "domain", path: str = "path") -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(kind.alias("kind"), F.col(domain).alias("domain"), F.col(path).alias("path"), detail.cast("string").alias("detail"))


def metadata(docs: DataFrame) -> DataFrame:
    """docs: path, domain, created, guid, title. Missing identity or time, and a domain that is not the folder's."""
    bad = F.col("created").isNull() | F.col("guid").isNull() | (F.trim("guid") == "")
    lacks = issues(docs.where(bad), "metadata_error", F.when(F.col("created").isNull(), "created").otherwise("guid"))
    top = F.split_part("path", F.lit("/"), F.lit(1))
    other = docs.where(F.col("path").isNotNull() & F.col("domain").isNotNull() & (top != F.col("domain")))
    return lacks.unionByName(issues(other, "domain_mismatch", top))


def duplicates(docs: DataFrame, value: str, kind: str) -> DataFrame:
    """Values that several documents of one domain hold: (kind, domain, path of the first, value). Nulls and blanks never repeat."""
    groups = docs.where(F.trim(value) != "").groupBy("domain", value).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return issues(groups.where("n > 1"), kind, F.col(value))


def across(docs: DataFrame, value: str, kind: str) -> DataFrame:
    """Values in more than one domain: (kind, domains, first path, value)."""
    per = docs.where(F.trim(value) != "").where("domain is not null").groupBy(value, "domain").agg(F.min("path").alias("path"))
    groups = per.groupBy(value).agg(F.array_join(F.array_sort(F.collect_list("domain")), ",").alias("domains"), F.count("*").alias("n"), F.min("path").alias("path"))
    return issues(groups.where("n > 1"), kind, F.col(value), "domains")


def missing_targets(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (domain, path, target path) whose target is no file."""
    gone = links.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_anti")
    return issues(gone, "missing_attachment", F.col("target"))


def index_drift(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """entries (domain, path) of an index against docs (domain, path): dead, missing and repeated entries, domains without an index."""
    docs = docs.where("path is not null")
    dead = entries.join(docs.select("domain", "path"), ["domain", "path"], "left_anti").distinct()
    have = entries.select("domain").distinct()
    lacks = docs.join(entries.select("domain", "path"), ["domain", "path"], "left_anti").join(have, "domain", "left_semi").select("domain", "path").distinct()
    none = docs.select("domain").where("domain is not null").distinct().join(have, "domain", "left_anti").withColumn("path", F.lit(None).cast("string"))
    extra = entries.groupBy("domain", "path").agg(F.count("*").alias("n")).where("n > 1")
    parts = [
        issues(dead, "missing_index_target", F.col("path")),
        issues(lacks, "index_missing_article", F.col("path")),
        issues(none, "missing_index", F.col("domain")),
        issues(extra, "index_extra_article", F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def selection(docs: DataFrame, cache: DataFrame, allowed: list[str], since, until) -> DataFrame:
    """docs (guid, domain, path, created) against their cached selection (guid, canonical_path, outcome, keywords array).

    Only guids that the cache knows as accepted are expected. Codes: out_of_range_article, missing_keyword_cache,
    unexpected_canonical_file, canonical_path_mismatch, matched_keywords_invalid.
    """
    expected = cache.groupBy("guid").agg(F.max(F.struct((F.col("outcome") == "accepted").alias("ok"), "canonical_path", "keywords")).alias("c"))
    j = docs.where("path is not null").join(expected, "guid", "left")
    codes = F.array(
        F.when(~((F.col("created") >= F.lit(since)) & (F.col("created") < F.lit(until))), "out_of_range_article"),
        F.when(F.col("c").isNull(), "missing_keyword_cache"),
        F.when(~F.col("c.ok"), "unexpected_canonical_file"),
        F.when(F.col("c.ok") & ~F.col("c.canonical_path").eqNullSafe(F.col("path")), "canonical_path_mismatch"),
        F.when(F.size(F.array_except("c.keywords", F.array(*[F.lit(a) for a in allowed]))) > 0, "matched_keywords_invalid"),
    )
    return issues(j.withColumn("kind", F.explode(F.filter(codes, lambda x: x.isNotNull()))), F.col("kind"), F.col("guid"))


def export_codes(docs: DataFrame, allowed: list[str], since, until, mode: str) -> DataFrame:
    """docs (guid, domain, path, created, type, expected) joined with the newest cached selection c (h: its hash, o: outcome, p: path, null
    without one), its keywords ks and terms ts (arrays, null where they can't be read): one row for each code that holds.
    """
    outside = lambda xs, ys: F.size(F.array_except(xs, ys)) > 0
    when = {
        "out_of_range_article": ~((F.col("created") >= F.lit(since)) & (F.col("created") < F.lit(until))),
        "selection_mode_mismatch": ~F.col("type").eqNullSafe(F.lit(mode)),
        "selection_hash_mismatch": F.col("c.h") != F.col("expected"),
        "matched_keywords_invalid": outside("ks", F.array(*[F.lit(a) for a in allowed])),
        "missing_keyword_cache": F.col("c").isNull(),
        "unexpected_canonical_file": F.col("c.o") != "accepted",
        "canonical_path_mismatch": (F.col("c.o") == "accepted") & (F.col("c.p") != F.col("path")),
        "matched_keywords_mismatch": outside("ks", "ts"),
    }
    codes = F.filter(F.array(*[F.when(c, k) for k, c in when.items()]), lambda x: x.isNotNull())
    return issues(docs.withColumn("kind", F.explode(codes)), F.col("kind"), F.col("guid"))


def properties(docs: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """docs (domain, path, fields map): required fields that are missing or have a value that is not allowed."""
    found = F.array(
        *[
            F.when(F.col("fields")[k].isNull(), F.struct(F.lit("INVALID_FRONTMATTER").alias("kind"), F.lit(k).alias("detail"))).when(
                ~F.col("fields")[k].isin(v), F.struct(F.lit("INVALID_PROPERTY_VALUE").alias("kind"), F.concat(F.lit(f"{k}="), F.col("fields")[k]).alias("detail"))
            )
            for k, v in allowed.items()
        ]
    )
    rows = docs.select("domain", "path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i"))
    return rows.select("i.kind", "domain", "path", "i.detail")


def region_valid(text: Column, start: str, end: str) -> Column:
    """Exactly one start mark and one end mark, in this order."""
    one = lambda m: (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) == len(m)
    return one(start) & one(end) & (F.instr(text, start) < F.instr(text, end))


def log_order(entries: DataFrame, position: str, time: str) -> DataFrame:
    """entries (position, time string with offset) with problem: unreadable, goes_back, other_offset, or null.

    Each is compared with the last readable entry before it. The log is cut into ranges of position; each range gets the last
    readable entry of those before it, from a table of one row for each range.
    """
    from pyspark.sql import Window

    from quillmill.session import in_ranges

    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    at = F.try_to_timestamp(F.col(time))
    offset = F.regexp_replace(F.regexp_extract(time, r"(Z|[+-]\d{2}:?\d{2})$", 1), "Z", "+00:00")
    e = in_ranges(entries.withColumn("_at", at).withColumn("_e", F.when(F.col("_at").isNotNull(), F.struct("_at", offset.alias("_off")))), position)
    ends = e.groupBy("_part").agg(F.max(F.when(F.col("_e").isNotNull(), F.struct(F.col(position).alias("x"), "_e")))["_e"].alias("_end"))
    ends = ends.select("_part", F.last("_end", ignorenulls=True).over(before(Window.orderBy("_part"))).alias("_carried"))
    e = e.join(F.broadcast(ends), "_part")
    e = e.withColumn("_b", F.coalesce(F.last("_e", ignorenulls=True).over(before(Window.partitionBy("_part").orderBy(position))), "_carried"))
    e = e.withColumns({"_off": F.col("_e._off"), "_before": F.col("_b._at"), "_off_before": F.col("_b._off")})
    problem = F.when(F.col("_at").isNull(), "unreadable").when(F.col("_at") < F.col("_before"), "goes_back").when(F.col("_off") != F.col("_off_before"), "other_offset")
    return e.withColumn("problem", problem).drop("_part", "_at", "_e", "_b", "_carried", "_off", "_before", "_off_before")


def allowed_paths(files: DataFrame, patterns: list[str]) -> DataFrame:
    """files (path) that match none of the patterns."""
    ok = F.lit(False)
    for p in patterns:
        ok = ok | F.col("path").rlike(p)
    return files.where(~F.coalesce(ok, F.lit(False)))


def decision_problems(moves: DataFrame, trash: DataFrame, docs: DataFrame) -> DataFrame:
    """moves (path, domain), trash (path) against docs (path): unknown, in both, or without the form of a stored path."""
    bad = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("domain"), "path", F.lit(kind).alias("detail"))
    all_ = moves.select("path").union(trash.select("path"))
    return (
        bad(all_.join(docs.select("path"), "path", "left_anti").distinct(), "unknown_path")
        .unionByName(bad(moves.select("path").intersect(trash.select("path")), "moved_and_trashed"))
        .unionByName(bad(all_.where(~F.col("path").rlike(MONTH_PATH)).distinct(), "invalid_path"))
    )


def summary(found: DataFrame) -> DataFrame:
    """(kind, n) of an issue table."""
    return found.groupBy("kind").agg(F.count("*").alias("n"))
