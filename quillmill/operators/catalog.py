"""The result catalog: cache lookups, upserts, touching and statistics.

A catalog is a table with a key. Upserts give the new table (write it beside the old one and swap); there are no in-place updates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(candidates: DataFrame, catalog: DataFrame, key: str, version: list[str]) -> DataFrame:
    """candidates with state: hit (key and version equal), stale (key known with another version only), miss.

    catalog may hold several rows for a key; null keys and null versions never hit.
    """
    exact = catalog.select(key, *version).distinct().withColumn("_hit", F.lit(True))
    known = catalog.select(key).distinct().withColumn("_known", F.lit(True))
    joined = candidates.join(exact, [key, *version], "left").join(known, key, "left")
    state = F.when(F.col("_hit"), "hit").when(F.col("_known"), "stale").otherwise("miss")
    return joined.withColumn("state", state).drop("_hit", "_known").select(*candidates.columns, "state")


def misses(candidates: DataFrame, catalog: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Candidates whose body is needed: those without a hit."""
    return candidates.join(catalog.select(key, *version), [key, *version], "left_anti").select(*candidates.columns)


def upsert(catalog: DataFrame, batch: DataFrame, key: list[str], preserve: list[str], order: list[str]) -> DataFrame:
    """The catalog after the batch: batch rows replace rows of their key, but keep the old values of preserve.

    Repeated keys in either side count once, the last by order. One shuffle: both sides are grouped together, and
    the newest comes out of a partial aggregate. A key with a null part is a key like others.
    """
    rest = [c for c in catalog.columns if c not in key]
    side = lambda df, n: df.select(*key, F.struct(F.lit(n).alias("__side"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *rest).alias("__x"))
    both = side(catalog, 0).unionByName(side(batch, 1))
    best = both.groupBy(*key).agg(F.max("__x").alias("__new"), F.max(F.when(F.col("__x.__side") == 0, F.col("__x"))).alias("__old"))
    return best.select(*key, *[F.coalesce(f"__old.{c}", f"__new.{c}").alias(c) if c in preserve else F.col(f"__new.{c}").alias(c) for c in rest]).select(*catalog.columns)


def touch(catalog: DataFrame, seen: DataFrame, key: list[str], column: str, value) -> DataFrame:
    """The catalog with column set for the keys of seen, which may repeat."""
    marks = seen.select(*key).distinct().withColumn("_seen", F.lit(True))
    out = catalog.join(marks, key, "left")
    return out.withColumn(column, F.when(F.col("_seen"), F.lit(value)).otherwise(F.col(column))).select(*catalog.columns)


def stats(catalog: DataFrame, outcome: str = "outcome", domain: str = "primary_domain") -> DataFrame:
    """(what, name, n): total, by outcome, by domain where there is one, in one pass by grouping sets."""
    named = catalog.select(F.col(outcome).alias("o"), F.when(F.trim(domain) != "", F.col(domain)).alias("d"))
    sets = named.groupingSets([[], ["o"], ["d"]], "o", "d").agg(F.count("*").alias("n"), F.grouping("o").alias("go"), F.grouping("d").alias("gd"))
    kind = F.when(F.col("go") + F.col("gd") == 2, "total").when(F.col("go") == 0, "outcome").otherwise("domain")
    return sets.select(kind.alias("what"), F.coalesce("o", "d").alias("name"), "n").where("what <> 'domain' or name is not null")
