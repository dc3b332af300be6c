"""Indexes of stored documents: by domain and month, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import month_folder


def entries(docs: DataFrame) -> DataFrame:
    """docs (domain, title, path, created, summary) with month and sort keys, for orderBy(domain, month desc, created desc, title)."""
    return docs.where("domain is not null and created is not null").select("domain", month_folder(F.col("created")).alias("month"), "created", "title", "path", "summary")


def render(docs: DataFrame) -> DataFrame:
    """(domain, month, lines, n): the index text of each month of a domain.

    Groups are months of a domain; their lines are sorted inside one row, so a month has to fit into one.
    """
    line = F.concat(F.lit("- [["), "path", F.lit("|"), "title", F.lit("]]"), F.when(F.col("summary") != "", F.concat(F.lit("："), "summary")).otherwise(""))
    e = entries(docs).where("path is not null").withColumn("line", line)
    # newest first, then by title: negative time sorts ascending together with the title
    key = F.struct((-F.unix_micros(F.col("created").cast("timestamp"))).alias("t"), "title", "path", "line")
    return e.groupBy("domain", "month").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(key)), lambda x: x["line"])).alias("lines"), F.count("*").alias("n"))
