"""Reports, plans and rewrites over stored documents: each gives a table that says what is or what would be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.attachments import url
from quillmill.operators.integrity import MONTH_PATH
from quillmill.session import in_ranges

#: The severity of each check that isn't an error.
WARNINGS = ["ORPHAN_KNOWLEDGE_NOTE", "INVALID_LOG_ENTRY"]
#: Endings of pictures.
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp"]


def with_severity(found: DataFrame) -> DataFrame:
    """Issue rows with severity: warning or error."""
    return found.withColumn("severity", F.when(F.col("kind").isin(WARNINGS), "warning").otherwise("error"))


def severities(report: DataFrame) -> DataFrame:
    """(errors, warnings, ok) of a report with severity: one row, also for an empty report. ok means no error."""
    counts = report.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return counts.withColumn("ok", F.col("errors") == 0)


def totals(articles: DataFrame, found: DataFrame) -> DataFrame:
    """(domain, articles, issues) of each domain that has either; null is a domain of its own."""
    a = articles.groupBy("domain").agg(F.count("*").alias("articles"))
    i = found.groupBy("domain").agg(F.count("*").alias("issues"))
    both = a.join(i.withColumnRenamed("domain", "_d"), F.col("domain").eqNullSafe(F.col("_d")), "full_outer")
    return both.select(F.coalesce("domain", "_d").alias("domain"), F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("issues", F.lit(0)).alias("issues"))


def three_way(manifest: DataFrame, archive: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of three states (path, sha), each with unique paths: where a path is missing first, else whether the hashes agree.

    status: not_in_manifest, not_in_archive, no_file, sha_differs or same. A null hash equals nothing but a null hash.
    """
    side = lambda df, n: df.where("path is not null").select("path", F.struct("sha").alias(n))
    j = side(manifest, "m").join(side(archive, "a"), "path", "full_outer").join(side(files, "f"), "path", "full_outer")
    same = F.col("m.sha").eqNullSafe(F.col("f.sha")) & F.col("m.sha").eqNullSafe(F.col("a.sha"))
    status = F.when(F.col("m").isNull(), "not_in_manifest").when(F.col("a").isNull(), "not_in_archive").when(F.col("f").isNull(), "no_file").when(~same, "sha_differs").otherwise("same")
    return j.select("path", status.alias("status"))


def latest_entries(batches: list[DataFrame], key: list[str]) -> DataFrame:
    """Manifests of runs, the oldest first, merged: of each key the entry of the last run. Adds run. Equal keys within a run give the largest entry."""
    rest = [c for c in batches[0].columns if c not in key]
    rows = None
    for n, b in enumerate(batches):
        part = b.select(*key, F.struct(F.lit(n).alias("run"), *rest).alias("e"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*key).agg(F.max("e").alias("e")).select(*key, "e.run", *[f"e.{c}" for c in rest])


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with place, from 1 on in that order over the whole table: places within ranges, after the rows of the ranges before."""
    parts = in_ranges(df, *order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_at", at).join(F.broadcast(sizes.select("_part", before.alias("_b"))), "_part").withColumn("place", F.col("_b") + F.col("_at")).drop("_part", "_at", "_b")


def known_domains(job: list[str], paths: DataFrame) -> DataFrame:
    """(domain, place): a job's domains in their order, then the other top folders of paths (path) by name."""
    spark = paths.sparkSession
    jobs = spark.createDataFrame(list(dict.fromkeys(job)) and [(n, i + 1) for i, n in enumerate(dict.fromkeys(job))], "domain string, place int")
    tops = paths.where(F.col("path").contains("/")).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("domain")).distinct().join(F.broadcast(jobs), "domain", "left_anti")
    rest = tops.withColumn("place", F.row_number().over(Window.orderBy("domain")) + len(set(job)))  # one row for each folder
    return jobs.unionByName(rest.select("domain", "place"))


def attachment_section(body: Column, names: Column) -> Column:
    """The section that lists the files of names that the body doesn't refer to, once each; '' without any."""
    target = lambda n: F.concat(F.lit("_attachments/"), url(n))
    rest = F.filter(F.array_distinct(names), lambda n: ~F.coalesce(F.contains(body, target(n)), F.lit(False)))
    ending = lambda n: F.lower(F.regexp_extract(n, r"[^.](\.[^.]*)$", 1))
    label = lambda n: F.replace(F.replace(n, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    line = lambda n: F.concat(F.when(ending(n).isin(IMAGE_ENDINGS), "!").otherwise("- "), F.lit("["), label(n), F.lit("]("), target(n), F.lit(")"))
    return F.when(F.size(rest) > 0, F.concat(F.lit("\n---\n\n## 附件\n\n"), F.array_join(F.transform(rest, line), "\n"))).otherwise("")


def valid_decision_path(path: Column, domains: list[str]) -> Column:
    """Exactly domain/month/name.md, of a known domain, without backslashes; null is not valid."""
    ok = path.rlike(MONTH_PATH) & F.split_part(path, F.lit("/"), F.lit(1)).isin(domains) & ~path.contains("\\")
    return F.coalesce(ok, F.lit(False))


def renamed(text: Column, names: dict[str, str]) -> Column:
    """text with the old domain names replaced in the header's domain line and at the start of the targets of links and wikilinks."""
    for old, new in names.items():
        text = F.regexp_replace(text, rf"(?m)\A(---\r?\n(?:[^\r\n]*\r?\n)*?domain: *[\"']?){old}([\"']? *)$", f"$1{new}$2")
        text = F.regexp_replace(text, rf"(\]\(|\[\[){old}/", f"$1{new}/")
    return text


def complete(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (doc_id, target) with files (path): (doc_id, refs, complete), complete where every target is a file."""
    have = files.select(F.col("path").alias("target")).distinct().withColumn("_have", F.lit(True))
    return refs.join(have, "target", "left").groupBy("doc_id").agg(F.count("*").alias("refs"), F.bool_and(F.col("_have").isNotNull()).alias("complete"))
