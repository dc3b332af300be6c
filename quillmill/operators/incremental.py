"""Incremental work: what is new or changed, what history outranks, what a transaction changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import strip
from quillmill.operators.dedup import FRESH


def sync_plan(remote: DataFrame, local: DataFrame) -> DataFrame:
    """remote (guid, updated...) with action: new, update, or skip if the local copy (guid, updated) is as new. Null times are oldest."""
    mine = local.groupBy("guid").agg(F.max("updated").alias("_local"), F.lit(True).alias("_have"))
    j = remote.join(mine, "guid", "left")
    newer = F.coalesce(F.col("updated"), F.lit(-1)) > F.coalesce(F.col("_local"), F.lit(-1))
    return j.withColumn("action", F.when(F.col("_have").isNull(), "new").when(newer, "update").otherwise("skip")).drop("_local", "_have")


def owners(history: DataFrame) -> DataFrame:
    """(title, owner): the freshest (updated, created, guid) of each stripped title."""
    t = strip(F.col("title"))
    return history.where(t != "").groupBy(t.alias("title")).agg(F.max(F.struct(*FRESH)).alias("owner"))


def against_history(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """candidates with rejected_by: the guid of a strictly fresher stored note of the same stripped title, else null."""
    j = candidates.withColumn("_t", strip(F.col("title"))).join(owners(history).withColumnRenamed("title", "_t"), "_t", "left")
    fresher = (F.col("owner") > F.struct(*FRESH)) & (F.col("owner.guid") != F.col("guid"))
    return j.withColumn("rejected_by", F.when(fresher, F.col("owner.guid"))).drop("_t", "owner")


def outdated(history: DataFrame, accepted: DataFrame) -> DataFrame:
    """Stored notes that a fresher accepted note of the same stripped title replaces, with its guid as replaced_by."""
    j = history.withColumn("_t", strip(F.col("title"))).join(owners(accepted).withColumnRenamed("title", "_t"), "_t")
    return j.where((F.struct(*FRESH) < F.col("owner")) & (F.col("guid") != F.col("owner.guid"))).withColumn("replaced_by", F.col("owner.guid")).drop("_t", "owner")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, before_sha, after_sha, before_size, after_size) of two states (path, sha, size): added, removed or changed."""
    side = lambda df, n: df.select("path", F.struct("sha", "size").alias(n))
    j = side(before, "b").join(side(after, "a"), "path", "full_outer")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a.sha").eqNullSafe(F.col("b.sha")), "changed")
    return j.withColumn("change", kind).where("change is not null").select("path", "change", F.col("b.sha").alias("before_sha"), F.col("a.sha").alias("after_sha"), F.col("b.size").alias("before_size"), F.col("a.size").alias("after_size"))


def final_paths(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """paths (path) with final: where a move (path, domain) puts it, else unchanged."""
    return paths.join(moves.select("path", F.col("domain").alias("_d")), "path", "left").withColumn(
        "final", F.when(F.col("_d").isNotNull(), F.concat("_d", F.regexp_replace("path", r"^[^/]+", ""))).otherwise(F.col("path"))
    ).drop("_d")


def quarantine(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """docs (guid, path) that the catalog (guid, outcome, canonical_path) doesn't want where they are, with the reason."""
    c = catalog.groupBy("guid").agg(F.max_by(F.struct("outcome", "canonical_path"), F.struct((F.col("outcome") == "accepted"), F.coalesce("canonical_path", F.lit("")))).alias("c"))
    j = docs.where("path is not null").join(c, "guid")
    reason = F.when(F.col("c.outcome") != "accepted", F.col("c.outcome")).when(F.trim("c.canonical_path") == "", None).when(F.col("c.canonical_path") != F.col("path"), "not canonical")
    return j.withColumn("reason", reason).where("reason is not null").select("guid", "path", "reason")
