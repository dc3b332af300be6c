"""Mixing sources to target shares (problem 7), by Sainte-Lague apportionment of equal-token blocks.

The mix has a total size in blocks of block_tokens. The blocks are allocated to the sources by highest quotients of target
share over odd divisors; a source gets no more blocks than its tokens times its repeats hold, and what it can't take goes to
the next quotients. Each source's quota is allocated by the same rule to its shards, by their tokens. Within a shard the
documents stand in a seeded order, and their running total cuts them into blocks: whole passes first, then the blocks of one
more pass until the quota is used. No document is split, none is used more than max_repeats times.

Unless a total is given, it is the largest at which every source that has any tokens can reach its share within its repeats;
the shares of sources without tokens fall to the others in proportion. Documents of no source, of a source without a target,
or without tokens are not used. Repeated targets for one source add up, with the smaller max_repeats.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apportion(weights: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 * seats so far + 1), up to most for each; ties to the earlier.

    The bulk is taken from the lower quota, which the highest quotients pass anyway unless a limit binds.
    """
    got = [0] * len(weights)
    free = [i for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    left = min(seats, sum(most[i] for i in free))
    while left > 0 and free:
        total, shared = sum(weights[i] for i in free), left + sum(got[i] for i in free)
        for i in free:
            add = max(0, min(int(shared * weights[i] / total) - 2, most[i]) - got[i])
            got[i] += add
            left -= add
        full = [i for i in free if got[i] >= most[i]]
        free = [i for i in free if got[i] < most[i]]
        if not full:
            break
    # from equal quotients on, one seat at a time
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in free]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


class Mix:
    """docs: id, n_tokens, source (written or cheap to read twice). targets: source, target_share, max_repeats."""

    def __init__(self, docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 1024, shard_tokens: int = 8_000_000, seed: int = 11):
        spark = docs.sparkSession
        goals = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats"))
        used = docs.where("source is not null and n_tokens > 0").join(F.broadcast(goals), "source")
        sums = used.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
        rows = goals.join(sums, "source", "left").orderBy("source").collect()  # one row for each source with a target
        have = [r for r in rows if r["tokens"]]
        weight = sum(r["share"] for r in have) or 1.0
        share = {r["source"]: r["share"] / weight for r in have}
        if total_tokens is None:
            total_tokens = int(min((r["tokens"] * max(0, r["repeats"]) / share[r["source"]] for r in have), default=0))
        # a block is small beside what the smallest source gives, so that whole blocks can meet its share
        least = min((share[r["source"]] * total_tokens for r in have), default=0)
        self.block = block = max(1, min(block_tokens, int(least / 20) or 1))
        seats = total_tokens // block
        most = [int(-(-r["tokens"] * max(0, r["repeats"]) // block)) for r in have]
        quota = dict(zip([r["source"] for r in have], apportion([share[r["source"]] for r in have], seats, most)))
        shards = {r["source"]: max(1, round(r["tokens"] / shard_tokens)) for r in have}
        self.total_tokens, self.quota, self._rows = total_tokens, quota, rows

        plan = spark.createDataFrame([(s, n, max(0, next(r["repeats"] for r in have if r["source"] == s))) for s, n in shards.items()], "source string, shards int, repeats int")
        placed = used.select("source", "id", "n_tokens").join(F.broadcast(plan), "source")
        order = F.xxhash64(F.lit(seed), F.col("id"))
        placed = placed.withColumn("shard", F.pmod(F.shiftright(order, 20), F.col("shards")).cast("int")).withColumn("at", order)
        # one row of three numbers for each shard_tokens tokens
        sizes = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")).orderBy("source", "shard").toPandas()
        repeats = {r["source"]: max(0, r["repeats"]) for r in have}
        quotas = [pd.DataFrame({"source": [], "shard": [], "blocks": [], "shard_tokens": []})]
        for s, own in sizes.groupby("source"):
            tokens = own["tokens"].tolist()
            got = apportion([float(t) for t in tokens], quota[s], [int(-(-t * repeats[s] // block)) for t in tokens])
            quotas.append(pd.DataFrame({"source": s, "shard": own["shard"], "blocks": got, "shard_tokens": tokens}))
        quotas = pd.concat(quotas).astype({"source": object, "shard": "int32", "blocks": "int64", "shard_tokens": "int64"})
        quotas = spark.createDataFrame(quotas, "source string, shard int, blocks long, shard_tokens long")

        run = Window.partitionBy("source", "shard").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = placed.join(quotas, ["source", "shard"]).withColumn("upto", F.sum("n_tokens").over(run))
        want = F.col("blocks") * block
        passes = F.floor(want / F.col("shard_tokens"))
        # of the last pass a document is used if more than half of it lies within the quota's blocks
        more = (F.col("upto") - F.col("n_tokens") / 2 <= want - passes * F.col("shard_tokens")).cast("long")
        uses = F.least(F.col("repeats").cast("long"), passes + more)
        block_no = F.floor((F.col("upto") - 1) / block).cast("long")
        self._chosen = cut.select("source", "id", "shard", block_no.alias("block"), "n_tokens", uses.cast("int").alias("uses")).where("uses > 0")

    def chosen(self) -> DataFrame:
        """(source, id, shard, block, n_tokens, uses): each document of the mix and how often it is used."""
        return self._chosen

    def report(self) -> DataFrame:
        """(source, target_share, tokens, share, documents, most_uses): the shares really reached, for every target."""
        goals = self._chosen.sparkSession.createDataFrame([(r["source"], float(r["share"]), int(r["docs"] or 0)) for r in self._rows], "source string, target_share double, available long")
        sums = self._chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
        joined = F.broadcast(goals).join(sums, "source", "left").na.fill(0, ["tokens", "documents", "most_uses"])
        total = F.sum("tokens").over(Window.partitionBy())  # one row for each target
        return joined.select("source", "target_share", "available", "documents", "most_uses", "tokens", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("share"))
