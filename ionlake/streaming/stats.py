"""Spectra that keep arriving: running totals on a fixed grid. An extension; nothing here is needed for batch work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "spectrum_id long, x int, y int, pos long, mz double, intensity double"


def read_points(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(POINTS).parquet(folder)


def running_spectrum(points: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Sums by bin of a fixed m/z range; the state is one row a bin. Write it in 'complete' or 'update' mode."""
    index = F.floor((F.col("mz") - low) * ((bins - 1) / (high - low)) + 1)
    return points.groupBy(F.greatest(F.lit(1), F.least(F.lit(bins), index)).cast("int").alias("bin")).agg(F.sum("intensity").alias("intensity"), F.count("*").alias("n"))


def running_image(points: DataFrame, mz: float, tol: float) -> DataFrame:
    """The largest intensity of each pixel in a window so far."""
    return points.where(F.col("mz").between(mz - tol, mz + tol)).groupBy("x", "y").agg(F.max("intensity").alias("intensity"))
