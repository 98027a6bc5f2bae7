"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that spark.checkpoint.dir names; one of our own where driver and executors are one process and none is set."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder and (context.master == "local" or context.master.startswith("local[")):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ionlake-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    """A path that exists is deleted when the session's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def own_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder, deleted when the session ends."""
    folder = shared_folder(spark)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    _gone_at_exit(spark, path)
    return path


def settled(frame: DataFrame) -> DataFrame:
    """The rows as they are now, without their lineage: a table in the shared folder, which goes when the session ends.

    A cluster without a shared folder keeps the rows on its executors; blocks that are lost with one are computed again.
    Either way plans that read them know their true size.
    """
    spark = frame.sparkSession
    if not (folder := shared_folder(spark)):
        kept = frame.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        return kept
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    _gone_at_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, 3... in that order, over all rows.

    The rows are sorted in ranges; a row's number is its place in its range and the sizes of the ranges before, one
    row a range. No window holds all rows.
    """
    at = F.monotonically_increasing_id()
    placed = settled(rows.orderBy(*order).withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")
