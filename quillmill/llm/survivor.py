"""One surviving record for each duplicate group (problem 5): skyline selection with filling from lower layers.

Criteria are completeness (each field, filled or not), recency, and levels such as trust. A record dominates another of its group if it
is at least as good in every criterion and better in one.
Layer 1 are the undominated records, layer 2 those that only records of layer 1 dominate, and so on. Within
a layer the lexicographic policy decides. Each field of the survivor comes from the first record in that order
that holds a usable value.

Only the policy-best record for each pattern of filled fields and each combination of the discrete criteria can ever give
a value, because it dominates its equals in pattern; so every group shrinks to at most 2 ** len(fields) * levels
records by partial aggregation, before any of them meet in one row. No group is ever gathered whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OLDEST = -1


def instant_micros(value: Column) -> Column:
    """Epoch time in seconds, milliseconds, microseconds or nanoseconds, told apart by size, as microseconds.

    Null, 0 and negative times give OLDEST.
    """
    return (
        F.when(value.isNull() | (value <= 0), F.lit(OLDEST))
        .when(value < 100_000_000_000, value * 1_000_000)
        .when(value < 100_000_000_000_000, value * 1_000)
        .when(value < 100_000_000_000_000_000, value)
        .otherwise((value / 1000).cast("bigint"))
        .cast("bigint")
    )


def usable_time(value: Column, last_seen: Column) -> Column:
    """instant_micros(), but OLDEST for a time later than last_seen (ISO time with offset; unreadable: no limit)."""
    seen = F.unix_micros(F.try_to_timestamp(last_seen))
    micros = instant_micros(value)
    return F.when(seen.isNotNull() & (micros > seen), F.lit(OLDEST)).otherwise(micros).cast("bigint")


def filled(value: Column) -> Column:
    """True for a value that is neither null nor blank."""
    return F.coalesce(value.cast("string").rlike(r"(?U)[^\s\x{200B}\x{FEFF}]"), F.lit(False))


def title_group(title: Column) -> Column:
    """NFKC, case folded, ends stripped; null for a null or blank title."""
    import unicodedata

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(values)
        made = [(unicodedata.normalize("NFKC", x).casefold().strip() or None) for x in uniques] + [None]
        return pd.Series(pd.Series(made, dtype=object).to_numpy()[codes], index=values.index)

    return form(title)


def _layers(records: list[dict], criteria: list[str]) -> list[list[dict]]:
    """Successive skylines of a short list."""
    rest, layers = list(records), []
    while rest:
        top = [
            r
            for r in rest
            if not any(all(o[c] >= r[c] for c in criteria) and any(o[c] > r[c] for c in criteria) for o in rest)
        ]
        layers.append(top)
        rest = [r for r in rest if not any(r is t for t in top)]
    return layers


def survivors(df: DataFrame, key: str, id_col: str, fields: list[str], recency: list[str], levels: list[str] = [], policy: list[str] | None = None) -> DataFrame:
    """One row for each group with at least two different ids.

    key: group column (null keys take no part). recency: columns compared in turn, larger is better; together with
    the id they are one criterion. Each field is a criterion too, filled or not (completeness). levels: further criteria with few values
    each, such as trust. policy: order of criteria within a layer, of "recency" and levels; default recency first.
    Columns: group_key, group_id (smallest id), top_id, n_ids_more_than_one (always true), n_rows, and a struct (id, value) for
    each field, null where no record of the group has a usable value. Ties in all criteria go to the larger id,
    then to the larger values. Null recency counts as oldest.
    """
    policy = policy or ["recency", *levels]
    rank = F.struct(*[F.coalesce(F.col(c), F.lit(OLDEST)).alias(f"r{i}") for i, c in enumerate(recency)], F.col(id_col).alias("id"))
    mask = F.concat(*[F.when(filled(F.col(f)), "1").otherwise("0") for f in fields]).alias("mask")
    record = F.struct(
        rank.alias("recency"),
        *[F.coalesce(F.col(c), F.lit(OLDEST)).alias(c) for c in levels],
        F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("v"),
    )
    slim = df.where(F.col(key).isNotNull() & F.col(id_col).isNotNull()).select(F.col(key).alias("group_key"), mask, record.alias("record"))
    # max of a struct is a partial aggregate: one row for each pattern and level leaves a map task, however hot its key
    best = slim.groupBy("group_key", "mask", *[F.col(f"record.{c}").alias(f"_{c}") for c in levels]).agg(
        F.max("record").alias("record"), F.min("record.recency.id").alias("lo"), F.max("record.recency.id").alias("hi"), F.count("*").alias("n")
    )
    groups = (
        best.groupBy("group_key")
        .agg(
            F.min("lo").alias("group_id"),
            F.max("hi").alias("last_id"),
            F.sum("n").alias("n_rows"),
            F.sort_array(F.collect_list(F.struct("record", "mask")), asc=False).alias("records"),
        )
        .where(F.col("group_id") != F.col("last_id"))
    )
    steps = F.transform(F.col("records"), lambda x: F.struct(x["mask"].alias("mask"), *[x["record"][c].alias(c) for c in levels]))
    groups = groups.withColumn("order", _layer_order(levels, policy)(steps))
    groups = groups.withColumn("records", F.expr("transform(order, i -> records[i])")).drop("order")
    holders = [
        F.expr(f"get(filter(records, x -> substring(x.mask, {i + 1}, 1) = '1'), 0)").alias(f"h{i}")
        for i in range(len(fields))
    ]
    return groups.select(
        "group_key",
        "group_id",
        F.col("records")[0]["record"]["recency"]["id"].alias("top_id"),
        "n_rows",
        *holders,
    ).select(
        "group_key",
        "group_id",
        "top_id",
        "n_rows",
        *[
            F.when(F.col(f"h{i}").isNotNull(), F.struct(F.col(f"h{i}.record.recency.id").alias("id"), F.col(f"h{i}.record.v.{f}").alias("value"))).alias(f)
            for i, f in enumerate(fields)
        ],
    )


def _layer_order(levels: list[str], policy: list[str]):
    """Positions of the records by layer, then by policy; the list is short by construction."""

    @F.pandas_udf("array<int>")
    def order(lists: pd.Series) -> pd.Series:
        out, known = [], {}
        for records in lists:
            shape = tuple(tuple(x.values()) for x in records)
            if shape not in known:
                # the list is sorted by recency, newest first
                rows = [{"recency": len(records) - i, "at": i} | x | {f"filled{k}": m for k, m in enumerate(x["mask"])} for i, x in enumerate(records)]
                criteria = ["recency", *levels, *[c for c in rows[0] if c.startswith("filled")]]
                known[shape] = [r["at"] for layer in _layers(rows, criteria) for r in sorted(layer, key=lambda r: [-r[c] for c in policy])]
            out.append(known[shape])
        return pd.Series(out)

    return order


def found_rows(groups: DataFrame, id_name: str, fields: list[str]) -> DataFrame:
    """(group_guid, field_name, source_guid): the top record, and the source of each field that has one."""
    entries = [F.struct(F.lit(id_name).alias("field_name"), F.col("top_id").alias("source_guid"))]
    entries += [F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.id").alias("source_guid")) for f in fields]
    return (
        groups.select(F.col("group_id").alias("group_guid"), F.explode(F.array(*entries)).alias("e"))
        .select("group_guid", "e.field_name", "e.source_guid")
        .where(F.col("source_guid").isNotNull())
    )
