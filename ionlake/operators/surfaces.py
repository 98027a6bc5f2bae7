"""Smoothed surfaces of images, tile by tile."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256


def weights(sigma: float) -> np.ndarray:
    """The Gaussian's values from -2 ceil(sigma) to 2 ceil(sigma), with the sum 1."""
    half = 2 * math.ceil(sigma)
    w = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def _along(values: np.ndarray, w: np.ndarray, axis: int) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(values, len(w), axis=axis)
    return windows @ w


def gaussian(image: DataFrame, width: int, height: int, sigma: float = 3.0, value: str = "intensity", tile: int = TILE) -> DataFrame:
    """(x, y, ``value``) of every pixel of the raster: its surroundings weighted by a Gaussian along both axes.

    Beyond the raster the border repeats. Pixels without a row are 0; NaN takes no part, so weights are shared by the
    other pixels, and stays NaN where nothing else is near. Of several rows of a pixel the largest value counts.
    Every pixel goes to its own tile and to those whose halo holds it: one shuffle, and no task sees more than a tile
    and its halo.
    """
    w = weights(sigma)
    half = len(w) // 2
    reach = lambda c: F.sequence(F.floor((F.greatest(F.lit(1), F.col(c) - half) - 1) / tile), F.floor((F.col(c) + half - 1) / tile))
    pixels = image.where(F.col("x").between(1, width) & F.col("y").between(1, height)).groupBy("x", "y").agg(F.max(value).cast("double").alias("v"))
    sent = pixels.withColumn("tx", F.explode(reach("x"))).withColumn("ty", F.explode(reach("y")))
    across, down = -(-width // tile), -(-height // tile)
    every = image.sparkSession.range(across * down).select((F.col("id") % across).alias("tx"), F.floor(F.col("id") / across).alias("ty"))
    dealt = sent.where((F.col("tx") < across) & (F.col("ty") < down)).unionByName(every, allowMissingColumns=True)

    def smooth(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, top = int(key[0]) * tile, int(key[1]) * tile
        right, bottom = min(width, left + tile), min(height, top + tile)
        x0, x1, y0, y1 = max(0, left - half), min(width, right + half), max(0, top - half), min(height, bottom + half)
        dense, rows = np.zeros((y1 - y0, x1 - x0)), rows[rows["x"].notna()]
        x, y = rows["x"].to_numpy(int) - 1 - x0, rows["y"].to_numpy(int) - 1 - y0
        inside = (x >= 0) & (x < x1 - x0) & (y >= 0) & (y < y1 - y0)
        dense[y[inside], x[inside]] = rows["v"].to_numpy(float)[inside]
        edge = ((half - (top - y0), half - (y1 - bottom)), (half - (left - x0), half - (x1 - right)))
        dense = np.pad(dense, edge, mode="edge")
        there = ~np.isnan(dense)
        sums = _along(_along(np.where(there, dense, 0.0), w, 0), w, 1)
        if not there.all():
            with np.errstate(invalid="ignore", divide="ignore"):
                sums = sums / _along(_along(there.astype(float), w, 0), w, 1)
        ys, xs = np.mgrid[top + 1 : bottom + 1, left + 1 : right + 1]
        return pd.DataFrame({"x": xs.ravel(), "y": ys.ravel(), value: sums.ravel()})

    return dealt.groupBy("tx", "ty").applyInPandas(smooth, f"x int, y int, {value} double")


def surface(image: DataFrame, width: int, height: int, sigma: float = 3.0, value: str = "intensity", mask: DataFrame | None = None) -> DataFrame:
    """The smoothed raster; with a mask its pixels alone, in the box that holds them: (x, y) counts from the box's corner."""
    smooth = gaussian(image, width, height, sigma, value)
    if mask is None:
        return smooth
    kept = smooth.join(mask.select("x", "y").distinct(), ["x", "y"], "left_semi")
    box = mask.where(F.col("x").between(1, width) & F.col("y").between(1, height)).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    return kept.crossJoin(F.broadcast(box)).select((F.col("x") - F.col("x0") + 1).alias("x"), (F.col("y") - F.col("y0") + 1).alias("y"), value)
