"""Session factory, the shared folder, and written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "quillmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; conf overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where the session names none and its master is local (tests on one machine) a temporary folder is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def filled_frames(function):
    """A function for mapInPandas without its empty frames, which have no types of their own to convert."""

    def run(batches):
        for frame in function(batches):
            if len(frame):
                yield frame

    return run


_written: list[str] = []


def release_tables(spark: SparkSession) -> int:
    """Delete the tables that this process has written so far; results that read them must be done. Returns their number."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which release_tables() deletes."""
    path = os.path.join(shared_folder(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage at a table that outlives any executor, and later passes
    read columns of it instead of computing df again. release_tables() deletes what was written.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order) -> DataFrame:
    """df as a written table with _part: all rows of a lower _part come before those of a higher one, and equal rows are in one."""
    from pyspark.sql import functions as F

    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
