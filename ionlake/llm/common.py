"""What the operators of this subpackage share: table access, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define word boundaries.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where a session
    in one process has none (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if folder:
        return folder
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ionlake-"))
    return context._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables written to the shared folder. They cut lineage and survive lost executors.

    ``drop`` removes a table once a later one replaces it; what a returned DataFrame still reads goes when the session ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(where)
        system.deleteOnExit(where)

    def write(self, frame: DataFrame, **options: str | int) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.root}/{self.count}"
        frame.write.options(compression="zstd", **options).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path), path

    def keep(self, frame: DataFrame, **options: str | int) -> DataFrame:
        return self.write(frame, **options)[0]

    def gather(self, frames: Iterable[DataFrame]) -> tuple[DataFrame, str]:
        """One table of all frames, which are made and written one after another: the shuffles of one go before the next."""
        out = None
        for frame in frames:
            if out is None:
                out = self.write(frame)
            else:
                frame.write.mode("append").option("compression", "zstd").parquet(out[1])
            self.release()
        return self.spark.read.schema(out[0].schema).parquet(out[1]), out[1]  # lists the files anew

    def settle(self, frame: DataFrame) -> DataFrame:
        """Writes what is needed from here on and deletes all tables before it."""
        before = [f"{self.root}/{k}" for k in range(1, self.count + 1)]
        out = self.keep(frame)
        self.drop(*before)
        return out

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more: the first pass frees the
        plans, the second what they alone held."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *paths: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def slices(batches: Iterable[pa.RecordBatch], column: str, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each piece holds about ``budget`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        filled, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = filled[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(filled, base + budget, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
