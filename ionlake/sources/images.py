"""Image files as pixel tables: slices and masks, from Spark's binary file source to pixels and back."""

from __future__ import annotations

import datetime
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.functions import bitmaps, images
from ionlake.operators import regions
from ionlake.schema import FileFormatError
from ionlake.sources.files import Registry, write_png

#: Pixels a batch of rows holds.
BATCH = 1 << 18


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, x, y, intensity) of every pixel of bitmaps and PNG files, gray levels 0-1, (x, y) from 1 at the top left.

    Files come from any file system that Spark reads, each decoded by one task; a file that is neither format fails.
    """

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = bitmaps.decode(data.as_py())
                height, width = image.shape
                rows = max(1, BATCH // max(1, width))
                for top in range(0, height, rows):
                    part = image[top : top + rows]
                    ys, xs = np.indices(part.shape)
                    n = part.size
                    columns = [pa.array([name] * n), pa.array((xs.ravel() + 1).astype(np.int32)), pa.array((ys.ravel() + top + 1).astype(np.int32)), pa.array(part.ravel().astype(float))]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "x", "y", "intensity"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, x int, y int, intensity double")


def size_of(pixels: DataFrame) -> tuple[int, int]:
    top = pixels.agg(F.max("x").alias("w"), F.max("y").alias("h")).first()
    return top["w"] or 0, top["h"] or 0


def slice_mask(spark: SparkSession, path: str, **steps) -> dict[str, DataFrame]:
    """The steps of a mask (binary, opened, closed, smoothed) from a slice's image file."""
    pixels = read(spark, path)
    return regions.region_of_interest(pixels, *size_of(pixels), **steps)


def premade_mask(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """The true pixels (x, y) of a mask image, brought to a slice's size.

    An image with more than two levels is refused, unless all of them are below 0.1 or above 0.9. Levels above 0.5
    are true; the resized mask is true where its interpolated value exceeds a half.
    """
    pixels = read(spark, path)
    levels = pixels.agg(F.countDistinct("intensity").alias("n"), F.count_if(F.col("intensity").between(0.1, 0.9)).alias("middling")).first()
    if levels["n"] > 2 and levels["middling"]:
        raise FileFormatError(f"the mask has {levels['n']} gray levels: it is not black and white")
    return resized(pixels.withColumn("intensity", (F.col("intensity") > 0.5).cast("double")), width, height).where("intensity > 0.5").select("x", "y")


def resized(image: DataFrame, width: int, height: int, value: str = "intensity") -> DataFrame:
    """(x, y, ``value``) of a raster of another size, between the four nearest pixels, pixel centres aligned.

    Each new pixel names its four neighbours and joins them: weights and places come from its own coordinates.
    """
    w, h = size_of(image)
    if not w or not h:
        return image.select("x", "y", value).where("false")
    grid = image.sparkSession.range(width * height).select((F.col("id") % width + 1).cast("int").alias("x"), (F.floor(F.col("id") / width) + 1).cast("int").alias("y"))

    def ends(c: str, new: int, old: int):
        at = F.greatest(F.lit(0.0), F.least(F.lit(float(old - 1)), (F.col(c) - 0.5) * (old / new) - 0.5))
        low = F.floor(at)
        far = F.least(F.lit(old - 1), low + 1)
        return F.array(F.struct((low + 1).cast("int").alias("at"), (1 - (at - low)).alias("w")), F.struct((far + 1).cast("int").alias("at"), (at - low).alias("w")))

    near = grid.select("x", "y", F.explode(ends("x", width, w)).alias("a"), F.lit(0).alias("_")).select("x", "y", "a", F.explode(ends("y", height, h)).alias("b"))
    wanted = near.select("x", "y", F.col("a.at").alias("ax"), F.col("b.at").alias("by"), (F.col("a.w") * F.col("b.w")).alias("weight")).where("weight > 0")
    there = image.select(F.col("x").alias("ax"), F.col("y").alias("by"), F.col(value).alias("v"))
    return wanted.join(there, ["ax", "by"], "left").groupBy("x", "y").agg(F.sum(F.col("weight") * F.coalesce("v", F.lit(0.0))).alias(value))


def bounded_size(width: int, height: int, most: int) -> tuple[int, int]:
    """The size with the same aspect whose longer side is ``most``; sizes within it stay."""
    longest = max(width, height)
    return (width, height) if longest <= most else tuple(max(1, round(s * most / longest)) for s in (width, height))


def downsampled(image: DataFrame, most: int, value: str = "intensity") -> DataFrame:
    return resized(image, *bounded_size(*size_of(image), most), value)


def save_mask(mask: DataFrame, width: int, height: int, folder: str, dataset: str, registry: Registry) -> str:
    """Writes the mask's pixels as <dataset>.png, white on black, and names it in the data set's registry entry."""
    dense = np.zeros((height, width), np.uint8)
    for r in mask.where(F.col("x").between(1, width) & F.col("y").between(1, height)).select("x", "y").toLocalIterator():
        dense[r["y"] - 1, r["x"] - 1] = 255
    os.makedirs(folder, exist_ok=True)
    path = os.path.abspath(f"{folder}/{dataset}.png")
    write_png(dense, path)
    registry.update(dataset, defaults={"is_imzML": True, "processed_date": datetime.datetime.now().isoformat(timespec="seconds")}, mask_path=path, has_mask=True)
    return path


def dataset_mask(spark: SparkSession, registry: Registry, dataset: str, width: int, height: int) -> DataFrame | None:
    """The mask that the registry names for a data set, at the slice's size; None without one."""
    entry = registry.load().get(dataset, {})
    if not entry.get("has_mask"):
        return None
    if not os.path.exists(entry.get("mask_path", "")):
        raise FileFormatError(f"the mask of {dataset} is missing: {entry.get('mask_path')}")
    return premade_mask(spark, entry["mask_path"], width, height)


def colour_bar(spark: SparkSession, low: float, high: float, bins: int = 256) -> DataFrame:
    """(tick, value, label, exponent): evenly spaced ticks of a colour bar, labelled in powers of a thousand."""
    values = images.ticks(low, high, bins)
    largest = max(abs(v) for v in values)
    exponent = int(np.floor(np.log10(largest) / 3)) if largest > 0 else 0
    rows = [(k, float(v), f"{v / 10 ** (3 * exponent):.2f}", 3 * exponent) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "tick int, value double, label string, exponent int")


def clicked(x: float, y: float, width: int, height: int) -> tuple[int, int]:
    """The pixel under a click on a plot whose y axis runs from -height to -1."""
    return min(width, max(1, round(x))), min(-1, max(-height, round(y)))
