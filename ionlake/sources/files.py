"""Opening data sets and the small files around them: sync times, masks, bitmaps, feature tables, the registry."""

from __future__ import annotations

import contextlib
import json
import os
import struct
import time
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.functions import bitmaps
from ionlake.operators.tables import numbered, settled
from ionlake.schema import FileFormatError
from ionlake.sources.imzml import ImzmlDataSource
from ionlake.sources.mzml import MzmlDataSource


def register(spark: SparkSession) -> None:
    for source in (ImzmlDataSource, MzmlDataSource):
        spark.dataSource.register(source)


def open_dataset(spark: SparkSession, path: str, sample_types: dict[int, str] | None = None) -> DataFrame:
    """Spectra of an .imzML or .mzML file, with ``sample_type`` 'sample' or what the map says of their index."""
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".imzml", ".mzml"):
        raise FileFormatError(f"{kind} is neither .imzML nor .mzML")
    register(spark)
    rows = spark.read.format(kind[1:]).load(path)
    if not sample_types:
        return rows.withColumn("sample_type", F.lit("sample"))
    given = spark.createDataFrame(list(sample_types.items()), "spectrum_id long, given string")
    return rows.join(given, "spectrum_id", "left").withColumn("sample_type", F.coalesce("given", F.lit("sample"))).drop("given")


def lookup(spark: SparkSession, path: str, condition: str) -> DataFrame:
    """The spectra of a file that meet an SQL condition, such as 'spectrum_id = 7' or 'x = 3 and y between 1 and 4'.

    Comparisons with spectrum_id, x and y reach the reader, which then opens only the byte ranges of those spectra.
    Spark keeps what a Python reader was told in the relation itself, where a second plan over it would find the
    filters of the first. So each call reads through a relation of its own, and a sample of everything stands between
    it and whatever is done with the result: no other filter passes that, and every plan tells the reader the same.
    """
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".imzml", ".mzml"):
        raise FileFormatError(f"{kind} is neither .imzML nor .mzML")
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(kind[1:]).option("pushdown", "true").load(path).where(condition).sample(1.0)


def scan_times(spark: SparkSession, path: str) -> DataFrame:
    """(spectrum_id, scan_time_ms) of an mzML file, with or without an index."""
    register(spark)
    return spark.read.format("mzml").load(path).select("spectrum_id", "scan_time_ms")


def points_of(spectra: DataFrame) -> DataFrame:
    keep = [c for c in ("spectrum_id", "x", "y") if c in spectra.columns]
    rows = spectra.select(*keep, F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p"))
    return rows.select(*keep, F.col("pos").cast("long").alias("pos"), "p.mz", "p.intensity")


def read_sync(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(x, y, t) from lines 'x, y, ms', or, with the raster's width, from lines 'index, ms'; two header lines are skipped."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.split(F.trim("value"), r"\s*[,;\t]\s*|\s+").alias("c")).where("n >= 2 and size(c) >= 2")
    i = F.col("c")[0].cast("long") - 1
    flat = F.struct((i % F.lit(width or 1) + 1).cast("int").alias("x"), (F.floor(i / F.lit(width or 1)) + 1).cast("int").alias("y"), F.col("c")[1].cast("double").cast("long").alias("t"))
    full = F.struct(F.col("c")[0].cast("int").alias("x"), F.col("c")[1].cast("int").alias("y"), F.get("c", F.lit(2)).cast("double").cast("long").alias("t"))
    return lines.select(F.when(F.size("c") >= 3, full).otherwise(flat).alias("r")).select("r.*")


#: Columns of a file of a wide matrix.
COLUMNS = 1000


def write_matrix(features: DataFrame, folder: str, row: str = "spectrum_id", column: str = "mz", value: str = "value", columns: int = COLUMNS) -> None:
    """A wide matrix as CSV files of at most ``columns`` columns each, from its long form (row, column, value).

    ``columns.csv`` numbers the distinct columns in their order; block=k/ holds the rows' values of columns k *
    ``columns`` and on, nothing where the long form has no entry, the greatest where it has several. A line is made
    from the entries of one row in one block, so neither rows nor columns are bounded and no plan has a column a bin.
    """
    names = features.select(column).distinct().where(F.col(column).isNotNull())
    numbers = settled(numbered(names, [column], "k").withColumn("k", F.col("k") - 1))
    numbers.orderBy("k").coalesce(1).write.mode("overwrite").csv(f"{folder}/columns.csv", header=True)
    entries = features.groupBy(row, column).agg(F.max(value).alias("v")).join(numbers, column).withColumn("block", F.floor(F.col("k") / columns))
    widths = numbers.groupBy(F.floor(F.col("k") / columns).alias("block")).agg(F.count("*").cast("int").alias("width"))
    cells = entries.groupBy("block", row).agg(F.map_from_entries(F.collect_list(F.struct((F.col("k") % columns).cast("int").alias("i"), F.col("v").cast("string")))).alias("cells"))
    lines = cells.join(F.broadcast(widths), "block").select("block", F.lit(1).alias("place"), F.col(row).cast("string").alias("name"), F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(""))).alias("v"))
    heads = numbers.groupBy(F.floor(F.col("k") / columns).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.col(column).cast("string").alias("c")))), lambda s: s["c"]).alias("v"))
    text = lines.union(heads.select("block", F.lit(0), F.lit(row), "v")).select("block", "place", "name", F.concat_ws(",", "name", F.array_join("v", ",")).alias("line"))
    dealt = text.repartition("block").sortWithinPartitions("block", "place", "name")
    dealt.select("block", "line").write.mode("overwrite").partitionBy("block").text(f"{folder}/matrix")


def read_matrix(spark: SparkSession, folder: str, row: str = "spectrum_id", column: str = "mz") -> DataFrame:
    """The long form (row, column, value as text) of a written matrix; cells without a value have no row."""
    lines = spark.read.option("basePath", f"{folder}/matrix").text(f"{folder}/matrix").select(F.col("block").cast("long").alias("block"), F.split("value", ",").alias("c"))
    cells = lines.where(F.col("c")[0] != row).select("block", F.col("c")[0].alias(row), F.posexplode(F.slice("c", 2, F.size("c"))).alias("i", "value")).where("value <> ''")
    names = spark.read.csv(f"{folder}/columns.csv", header=True)
    width = names.count() if not (first := lines.where((F.col("c")[0] == row) & (F.col("block") == 0)).head()) else len(first["c"]) - 1
    return cells.withColumn("k", F.col("block") * width + F.col("i")).join(names.withColumn("k", F.col("k").cast("long")), "k").select(row, column, "value")


def write_features(binned: DataFrame, folder: str) -> None:
    """feature_matrix_simple (m/z, intensity) in order, and feature_matrix_standard: one sample, a column a bin, in blocks."""
    binned.select("mz", "intensity").orderBy("mz").write.mode("overwrite").csv(f"{folder}/feature_matrix_simple", header=True)
    one = binned.select(F.lit("aggregated_spectrum").alias("sample_type"), F.format_string("%.4f", "mz").cast("decimal(20,4)").alias("mz"), "intensity")
    write_matrix(one, f"{folder}/feature_matrix_standard", "sample_type", "mz", "intensity")


def dense(image: DataFrame, value: str = "intensity") -> np.ndarray:
    """An image, indexed [y, x], zero where it has no pixel. One raster is small; it comes to the driver."""
    rows = image.select("x", "y", value).toPandas()
    out = np.zeros((int(rows["y"].max()) if len(rows) else 0, int(rows["x"].max()) if len(rows) else 0))
    if len(rows):
        out[rows["y"] - 1, rows["x"] - 1] = rows[value]
    return out


def write_bmp(levels: np.ndarray, path: str, palette: list[int] | None = None) -> None:
    """An 8-bit bitmap, stretched to 0-255, rows from the bottom, padded to 4 bytes."""
    low, high = (float(levels.min()), float(levels.max())) if levels.size else (0.0, 0.0)
    scaled = np.rint((levels - low) * 255 / (high - low)).astype(np.uint8) if high > low else np.zeros(levels.shape, np.uint8)
    height, width = scaled.shape
    stride = -(-width // 4) * 4
    body = b"".join(row.tobytes() + bytes(stride - width) for row in scaled[::-1])
    colours = struct.pack("<256I", *(palette or bitmaps.palette_of(bitmaps.GRAY)))
    with open(path, "wb") as out:
        out.write(struct.pack("<2sIHHI", b"BM", 1078 + len(body), 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, len(body), 2835, 2835, 256, 256) + colours + body)


def read_png(path: str) -> np.ndarray:
    """Gray levels 0-1 of a PNG; colours by the usual luma weights."""
    with open(path, "rb") as file:
        return bitmaps.decode_png(file.read())


def write_png(levels: np.ndarray, path: str) -> None:
    rows = np.asarray(levels, np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = zlib.compress(b"".join(b"\0" + r.tobytes() for r in rows))
    with open(path, "wb") as out:
        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b""))


class Registry:
    """Data sets by name in a JSON file. Changes are made under a lock, to what is in the file by then, and replace it at once.

    The lock is a file beside the registry that only one process can create; it names its owner. One that is older
    than STALE seconds belonged to a process that died and is taken over.
    """

    RETRIES, PAUSE, STALE = 200, 0.05, 30.0

    def __init__(self, path: str) -> None:
        self.path = path

    def load(self) -> dict[str, dict]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as file:
            return json.load(file)

    @contextlib.contextmanager
    def locked(self):
        """The entries, to be changed in place; they are written when the block ends without an error."""
        lock, owner = f"{self.path}.lock", f"{os.uname().nodename}-{os.getpid()}-{uuid.uuid4().hex}"
        for turn in range(self.RETRIES + 1):
            try:
                with os.fdopen(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as file:
                    file.write(owner)
                break
            except FileExistsError:
                with contextlib.suppress(FileNotFoundError):
                    if time.time() - os.stat(lock).st_mtime > self.STALE:
                        aside = f"{lock}.{owner}"
                        os.rename(lock, aside)  # only one process gets it
                        os.remove(aside)
                        continue
                if turn == self.RETRIES:
                    raise TimeoutError(f"{lock} is held") from None
                time.sleep(self.PAUSE)
        try:
            entries = self.load()
            yield entries
            with open(lock, encoding="utf-8") as file:
                if file.read() != owner:
                    raise TimeoutError(f"{lock} was taken over")
            self.save(entries)
        finally:
            with contextlib.suppress(FileNotFoundError), open(lock, encoding="utf-8") as file:
                if file.read() == owner:
                    os.remove(lock)

    def save(self, entries: dict[str, dict]) -> None:
        fresh = f"{self.path}.{uuid.uuid4().hex}"
        with open(fresh, "w", encoding="utf-8") as file:
            json.dump(entries, file, indent=1, sort_keys=True)
        os.replace(fresh, self.path)

    def update(self, name: str, defaults: dict | None = None, **fields) -> dict:
        """Sets fields of an entry, ``defaults`` only where the entry is new; other keys stay."""
        with self.locked() as entries:
            entries[name] = (entries.get(name) or dict(defaults or {})) | fields
            return entries[name]

    def reconcile(self, folders: set[str]) -> tuple[set[str], set[str]]:
        """Adds folders without an entry; drops entries whose folder and source are both gone."""
        with self.locked() as entries:
            new = folders - entries.keys()
            gone = {k for k in entries.keys() - folders if not os.path.exists(entries[k].get("source_path", ""))}
            for k in gone:
                del entries[k]
            entries.update({k: {} for k in new})
        return new, gone
