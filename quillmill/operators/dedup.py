"""Merging, ranking and deduplicating by freshness.

Freshness is the tuple (updated, created, guid), compared lexicographically, latest first; it never ties between
different guids. Winners come from max over a struct where the rest of the group is not needed (a partial aggregate, safe for hot keys),
and from row_number where positions are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import strip
from quillmill.session import in_ranges

FRESH = ["updated", "created", "guid"]


def freshest(df: DataFrame, key: list[str], fresh: list[str] = FRESH) -> DataFrame:
    """One row for each key, the freshest; null keys are a group of their own. Equal rows give one of them."""
    rest = [c for c in df.columns if c not in key]
    order = F.struct(*[F.col(c) for c in fresh if c not in key], *[F.col(c) for c in rest if c not in fresh])
    best = df.groupBy(*key).agg(F.max(order).alias("__best"))
    return best.select(*key, "__best.*").select(*df.columns)


def rank_candidates(hits: DataFrame, keywords: list[str]) -> DataFrame:
    """Search hits merged by guid, with rank: titles that contain a keyword first, then freshness.

    hits: guid, title, created, updated. Of several hits of one guid the latest updated counts, then created, then the larger title.
    Keywords are compared case-folded; an empty list matches no title.
    """
    merged = freshest(hits.select("guid", "title", "created", "updated"), ["guid"], ["updated", "created", "title"])
    match = F.lit(False)
    for k in keywords:
        match = match | F.lower("title").contains(k.lower())
    return merged.withColumn("in_title", F.coalesce(match, F.lit(False)))


def places(ranked: DataFrame) -> DataFrame:
    """All candidates with their place in rank order: places within ranges, after the rows of the ranges before (one row for each range)."""
    order = [F.desc("in_title"), *[F.desc(c) for c in FRESH]]
    parts = in_ranges(ranked, *order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = parts.withColumn("_at", within).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return placed.withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def by_title(df: DataFrame, title: str = "title") -> DataFrame:
    """The freshest row of each stripped title."""
    return freshest(df.withColumn(title, strip(F.col(title))), [title])


def top_titles(ranked: DataFrame, limit: int | None) -> DataFrame:
    """The first unique titles in rank order; None means all. A top-k, not a sort, when limited."""
    order = [F.desc("in_title"), *[F.desc(c) for c in FRESH]]
    unique = by_title(ranked).orderBy(*order)
    return unique if limit is None else unique.limit(limit)


def gate_then_dedup(ranked: DataFrame, matched: DataFrame, limit: int | None) -> DataFrame:
    """Of the candidates that passed the gate, one for each title, then the limit.

    matched: guid. The gate comes first, so an older note can win its title when the newest was rejected.
    """
    return top_titles(ranked.join(matched.select("guid"), "guid", "left_semi"), limit)


def claim_titles(df: DataFrame, claims: Column, title: str = "title") -> DataFrame:
    """df with outcome: in freshness order the first claiming row of each stripped title is accepted, later claimers are
    duplicate_title, the others rejected (they don't claim the title). Null titles are one title.

    The winner is a maximum, made in partial aggregates, so a hot title is never sorted. Guids are unique; a row that repeats its
    winner's whole freshness is accepted with it.
    """
    marked = df.withColumns({"_t": strip(F.col(title)), "_claims": F.coalesce(claims, F.lit(False)), "_fresh": F.struct(*FRESH)})
    winners = marked.where("_claims").groupBy("_t").agg(F.max("_fresh").alias("_winner")).withColumnRenamed("_t", "_w")
    j = marked.join(winners, F.col("_t").eqNullSafe(F.col("_w")), "left")
    outcome = F.when(~F.col("_claims"), "rejected").when(F.col("_fresh").eqNullSafe(F.col("_winner")), "accepted").otherwise("duplicate_title")
    return j.withColumn("outcome", outcome).select(*[c for c in df.columns if c != "outcome"], "outcome")


def canonical_names(df: DataFrame, group: list[str], name: Column) -> DataFrame:
    """df with winner and new_name: the freshest of each group; only winners of groups with several rows are renamed."""
    w = Window.partitionBy(*group)
    rank = F.row_number().over(w.orderBy(*[F.desc_nulls_last(c) for c in FRESH]))
    return df.withColumns({"winner": rank == 1, "copies": F.count("*").over(w)}).withColumn("new_name", F.when(F.col("winner") & (F.col("copies") > 1), name))


def unique_paths(df: DataFrame, folder: str, name: Column, guid: str) -> DataFrame:
    """df with path: folder/name.md; where several guids of a folder want one name, all but the first by guid get the first
    8 characters of their guid behind it, and if these are equal too, a hash of the whole guid."""
    safe = df.withColumn("_name", name)
    first = Window.partitionBy(folder, "_name").orderBy(guid)
    safe = safe.withColumn("_at", F.dense_rank().over(first))
    short = F.concat_ws("_", "_name", F.substring(guid, 1, 8))
    second = Window.partitionBy(folder, "_name", F.substring(guid, 1, 8), F.col("_at") > 1).orderBy(guid)
    safe = safe.withColumn("_again", F.dense_rank().over(second))
    stem = F.when(F.col("_at") == 1, F.col("_name")).when(F.col("_again") == 1, short).otherwise(F.concat_ws("_", "_name", F.substring(F.sha2(F.col(guid), 256), 1, 12)))
    return safe.withColumn("path", F.concat(F.col(folder), F.lit("/"), stem, F.lit(".md"))).drop("_name", "_at", "_again")


def keep_newest(df: DataFrame, n: int, group: list[str], time: str, tie: str) -> DataFrame:
    """df with keep: the n newest rows of each group."""
    w = Window.partitionBy(*group).orderBy(F.desc(time), F.desc(tie))
    return df.withColumn("keep", F.row_number().over(w) <= n)
