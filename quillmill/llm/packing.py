"""Filling containers of fixed capacity with items of varying length (problem 6), by linear grouping.

The items are spread over shards of bounded size, each packed by itself, for every capacity:

1. an item over the capacity is cut into pieces of the capacity and a rest, the only case in which an item is split;
2. large items (over capacity / small_part) are sorted and put into groups of equal cardinality, and each length is rounded up
   to the longest of its group, which leaves a few sizes;
3. configurations of these sizes are chosen by column generation: a linear program over the sizes, with a knapsack for
   each new configuration; the solution is rounded down, and what is left is packed by best fit;
4. the actual items take the places of their group, the longest first; the last place of a container goes to the longest item
   of any group that fits the room really left, so that what rounding took is given back;
5. the small items go, by decreasing size, into the fullest container that they fit.

Empty items (0 tokens) take no room: they go into the first container of their shard. Null sizes count as 0.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int, counts: np.ndarray, cells: int = 512) -> np.ndarray:
    """A configuration (number of each size) of about the greatest value; sizes are rounded up to capacity / cells."""
    unit = max(1, -(-capacity // cells))
    room = capacity // unit
    cost = -(-sizes // unit)
    best = np.zeros(room + 1)
    take: list[tuple[int, int, np.ndarray]] = []
    for i in np.argsort(-values / sizes):
        if values[i] <= 1e-12:
            continue
        k, left = 1, int(min(counts[i], room // cost[i] if cost[i] else 0))
        while left > 0:
            k = min(k, left)
            w = int(cost[i] * k)
            with_it = np.full(room + 1, -1.0)
            with_it[w:] = best[: room + 1 - w] + values[i] * k if w else best + values[i] * k
            used = with_it > best + 1e-12
            best = np.where(used, with_it, best)
            take.append((i, k, used))
            left -= k
            k *= 2
    out, at = np.zeros(len(sizes), int), room
    for i, k, used in reversed(take):
        if used[at]:
            out[i] += k
            at -= int(cost[i] * k)
    return out


def _least_containers(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, rounded down, for counts of a few sizes.

    Revised simplex on the covering program: the columns of the basis are configurations, the duals price sizes.
    """
    k = len(sizes)
    basis = np.diag(np.minimum(capacity // sizes, np.maximum(counts, 1)).astype(float))
    x = counts / np.diag(basis)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(k))
        new = _knapsack(np.maximum(duals, 0), sizes, capacity, counts)
        if duals @ new <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, new.astype(float))
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratios.argmin())
        if not np.isfinite(ratios[leave]):
            break
        x = x - ratios[leave] * direction
        x[leave] = ratios[leave]
        basis[:, leave] = new
    return [(basis[:, j].astype(int), int(x[j] + 1e-9)) for j in range(k) if x[j] + 1e-9 >= 1]


class _BestFit:
    """Containers by room left; an item goes where it leaves the least."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.n = capacity, [], 0

    def open(self, room: int | None = None) -> int:
        self.n += 1
        bisect.insort(self.rooms, (self.capacity if room is None else room, self.n - 1))
        return self.n - 1

    def put(self, size: int) -> int:
        at = bisect.bisect_left(self.rooms, (size, -1))
        if at == len(self.rooms):
            number = self.open()
            at = bisect.bisect_left(self.rooms, (self.capacity, number))
        room, number = self.rooms.pop(at)
        if room > size:
            bisect.insort(self.rooms, (room - size, number))
        return number


class _Stock:
    """Items by size; take() gives the longest that is not over a size. Emptied sizes are skipped by shortcuts."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray):
        self.own: dict[int, list[int]] = {}
        for i in items[::-1]:
            self.own.setdefault(int(sizes[i]), []).append(int(i))
        self.sizes = sorted(self.own)
        self.below = list(range(len(self.sizes)))  # own index while a size has items, else one further down

    def take(self, most: int) -> int | None:
        at = bisect.bisect_right(self.sizes, most) - 1
        path = []
        while at >= 0 and self.below[at] != at:
            path.append(at)
            at = self.below[at]
        for x in path:
            self.below[x] = at
        if at < 0:
            return None
        items = self.own[self.sizes[at]]
        item = items.pop()
        if not items:
            self.below[at] = at - 1
        return item

    def rest(self) -> list[int]:
        """What is left, the longest first."""
        return [i for size in reversed(self.sizes) for i in reversed(self.own[size])]


def pack(sizes: np.ndarray, capacity: int, groups: int = 12, small_part: int = 8) -> np.ndarray:
    """Container number of each item; sizes are from 0 to capacity."""
    out = np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    n_large = int((sizes > capacity / small_part).sum())
    large, small = order[:n_large], order[n_large:]
    fit = _BestFit(capacity)
    if n_large:
        per = -(-n_large // groups)
        number = np.arange(n_large) // per
        tops = sizes[large[::per]].astype(np.int64)  # the longest of each group, as they are sorted
        kinds, kind_of_group = np.unique(tops, return_inverse=True)
        kind = kind_of_group[number]
        counts = np.bincount(kind, minlength=len(kinds))
        stock = _Stock(large, sizes)
        for config, times in _least_containers(kinds, counts, capacity):
            places = [i for i in range(len(kinds) - 1, -1, -1) for _ in range(config[i])]  # the longest kind first
            for _ in range(times):
                own, room = [], capacity
                for i in places[:-1]:
                    item = stock.take(int(min(kinds[i], room)))
                    if item is not None:
                        own.append(item)
                        room -= int(sizes[item])
                while (item := stock.take(room)) is not None:
                    own.append(item)
                    room -= int(sizes[item])
                if not own:
                    break
                out[own] = fit.open(room)
        for i in stock.rest():
            out[i] = fit.put(int(sizes[i]))
    for i in small:
        if sizes[i] > 0:
            out[i] = fit.put(int(sizes[i]))
    return out


def assign_containers(sizes: DataFrame, capacities: DataFrame, per_shard: int = 20_000, groups: int = 12) -> DataFrame:
    """(capacity_id, id, piece, n_tokens, container): every item in containers of every capacity.

    sizes: id, n_tokens; capacities: capacity_id, max_tokens (null or non-positive ones are left out). container is unique within
    its capacity. Shards hold about per_shard items by a hash of the id, so no task grows with the input, and the loss
    is at most some containers a shard. Only ids and sizes are shuffled.
    """
    sizes = sizes.select("id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))
    shards = max(1, round(sizes.count() / per_shard))
    capacities = capacities.where("max_tokens > 0").select("capacity_id", F.col("max_tokens").cast("long").alias("max_tokens"))
    # one row for each capacity and item: a cross product with a table of a few capacities, not of items
    each = capacities.agg(F.sort_array(F.collect_list(F.struct("capacity_id", "max_tokens"))).alias("c")).collect()[0]["c"]
    options = F.array(*[F.struct(F.lit(c["capacity_id"]).cast("int").alias("capacity_id"), F.lit(c["max_tokens"]).cast("long").alias("cap")) for c in each])
    rows = sizes.select("id", "n_tokens", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(options).alias("c"))
    # of an item larger than a container, each full piece fills one; only what is left over, at most cap, is packed with others
    full = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("c.cap")) - 1).cast("long")
    rows = rows.select("id", "shard", "c.capacity_id", "c.cap", "n_tokens", full.alias("full"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        cap, full = int(pdf["cap"].iloc[0]), pdf["full"].to_numpy()
        rest = pdf["n_tokens"].to_numpy() - full * cap
        # coarse groups round more, fine ones leave fewer items for each place; the better of three is kept
        last = min((pack(rest, cap, max(1, g)) for g in (groups // 3, 2 * groups // 3, groups)), key=lambda c: c.max(initial=-1))
        first = last.max(initial=-1) + 1 + np.cumsum(full) - full
        return pdf[["capacity_id", "id", "cap", "n_tokens", "full", "shard"]].assign(last=last, first=first)

    filled = rows.groupBy("capacity_id", "shard").applyInPandas(
        fill, "capacity_id int, id long, cap long, n_tokens long, full long, shard int, last long, first long"
    )
    whole = F.col("piece") < F.col("full")
    return filled.select("*", F.explode(F.sequence(F.lit(0), F.col("full").cast("int"))).alias("piece")).select(
        "capacity_id",
        "id",
        "piece",
        F.when(whole, F.col("cap")).otherwise(F.col("n_tokens") - F.col("full") * F.col("cap")).alias("n_tokens"),
        (F.when(whole, F.col("first") + F.col("piece")).otherwise(F.col("last")) * shards + F.col("shard")).alias("container"),
    )


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, containers, fewest, fill): fewest is the least number by total size, fill the share of room used."""
    loads = packed.groupBy("capacity_id", "container").agg(F.sum("n_tokens").alias("load"))
    total = loads.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("largest"))
    return total.join(F.broadcast(capacities.select("capacity_id", "max_tokens")), "capacity_id").select(
        "capacity_id",
        "containers",
        F.ceil(F.col("tokens") / F.col("max_tokens")).alias("fewest"),
        "largest",
        (F.col("tokens") / (F.col("containers") * F.col("max_tokens"))).alias("fill"),
    )
