"""Structured Streaming forms of the incremental operators (an extension: the batch forms are complete without them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.operators.catalog import upsert


def unique_hits(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Search hits without row copies that arrive within delay of each other; columns guid, updated and pulled_at."""
    return stream.withWatermark("pulled_at", delay).dropDuplicatesWithinWatermark(["guid", "updated"])


def hits_per_window(stream: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, search_keyword, hits) by event time."""
    grouped = stream.withWatermark("pulled_at", delay).groupBy(F.window("pulled_at", window), "search_keyword")
    return grouped.agg(F.count("*").alias("hits")).select(F.col("window.start").alias("start"), "search_keyword", "hits")


def sync_catalog(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, key: list[str], preserve: list[str], order: list[str]) -> StreamingQuery:
    """Upsert each micro-batch into a catalog. write gets the new table and the batch number and has to be idempotent for it."""

    def each(batch: DataFrame, number: int) -> None:
        write(upsert(read(), batch, key, preserve, order), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
