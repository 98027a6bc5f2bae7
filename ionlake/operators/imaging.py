"""Ion images: the largest intensity in an m/z window at every pixel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many masses one scan with conditional aggregates serves them all; beyond, a join on m/z buckets.
FEW_MASSES = 8


def in_window(mz: float, tol: float) -> Column:
    return F.col("mz").between(mz - tol, mz + tol)


def _last_wins(per_spectrum: DataFrame, *keys: str) -> DataFrame:
    """Of several spectra at a pixel the one with the largest id counts."""
    return per_spectrum.where("intensity > 0").groupBy(*keys, "x", "y").agg(F.max_by("intensity", "spectrum_id").alias("intensity"))


def in_raster(width: int, height: int) -> Column:
    return F.col("x").between(1, width) & F.col("y").between(1, height)


def without_nan(value: str = "intensity") -> Column:
    return F.nanvl(F.col(value), F.lit(0.0)).alias(value)


def ion_image(points: DataFrame, mz: float, tol: float, mask: DataFrame | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """(x, y, intensity), sparse: only pixels with a positive maximum. The window reaches the scan as a filter.

    Of a raster of ``size`` (width, height) nothing outside counts; NaN intensities are 0.
    """
    rows = points.where(in_window(mz, tol) & in_raster(*size) if size else in_window(mz, tol)).withColumn("intensity", without_nan())
    if mask is not None:
        rows = masked(rows, mask, size)
    return _last_wins(rows.groupBy("spectrum_id", "x", "y").agg(F.max("intensity").alias("intensity")))


def masked(rows: DataFrame, mask: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """The rows at pixels of the mask (x, y); with the raster's ``size`` a mask that reaches beyond it is refused."""
    if size:
        top = mask.agg(F.max("x").alias("w"), F.max("y").alias("h")).first()
        if (top["w"] or 0) > size[0] or (top["h"] or 0) > size[1]:
            raise ValueError(f"the mask spans {top['w']} x {top['h']} pixels, the image {size[0]} x {size[1]}")
    return rows.join(mask, ["x", "y"], "left_semi")


def mask_flipped(mask: DataFrame, axis: str) -> DataFrame:
    """The mask (x, y) mirrored within the raster that it spans."""
    rows = mask.crossJoin(F.broadcast(mask.agg(F.max(axis).alias("top"))))
    turned = (F.col("top") - F.col(axis) + 1).cast("int").alias(axis)
    return rows.select(*((turned, "y") if axis == "x" else ("x", turned)))


def mask_shifted(mask: DataFrame, dx: int, dy: int) -> DataFrame:
    """The mask moved; what leaves the raster that it spans goes."""
    rows = mask.crossJoin(F.broadcast(mask.agg(F.max("x").alias("w"), F.max("y").alias("h")))).withColumn("x", (F.col("x") + dx).cast("int")).withColumn("y", (F.col("y") + dy).cast("int"))
    return rows.where((F.col("x") >= 1) & (F.col("y") >= 1) & (F.col("x") <= F.col("w")) & (F.col("y") <= F.col("h"))).select("x", "y")


def mask_inverse(mask: DataFrame) -> DataFrame:
    """The pixels of the raster that the mask spans and does not hold."""
    size = mask.agg(F.max("x").alias("w"), F.max("y").alias("h"))
    grid = size.select("h", F.explode(F.sequence(F.lit(1), "w")).alias("x")).select("x", F.explode(F.sequence(F.lit(1), "h")).alias("y"))
    return grid.join(mask, ["x", "y"], "left_anti").select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def outside(rows: DataFrame, mask: DataFrame) -> DataFrame:
    return rows.join(mask, ["x", "y"], "left_anti")


def ion_images(points: DataFrame, masses: list[float], tol: float) -> DataFrame:
    """(mass, x, y, intensity) of each mass by conditional aggregates: one scan, one shuffle of one row a spectrum."""
    wide = points.where(_any(masses, tol))
    per = wide.groupBy("spectrum_id", "x", "y").agg(*[F.max(F.when(in_window(m, tol), F.col("intensity"))).alias(f"m{k}") for k, m in enumerate(sorted(masses))])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(m)).alias("mass"), F.col(f"m{k}").alias("intensity")) for k, m in enumerate(sorted(masses))])).alias("e")
    return _last_wins(per.select("spectrum_id", "x", "y", pairs).select("spectrum_id", "x", "y", "e.mass", "e.intensity"), "mass")


def _any(masses: list[float], tol: float) -> Column:
    found = in_window(masses[0], tol)
    for m in masses[1:]:
        found = found | in_window(m, tol)
    return found


def ion_images_bucketed(points: DataFrame, masses: list[float], tol: float) -> DataFrame:
    """The same for many masses: an equi-join on m/z buckets as wide as a window, with the window as residual.

    A point has one bucket and a mass at most three, so no pair arises twice. The request is a list in memory,
    hence broadcast.
    """
    width = max(2 * tol, 0.01)
    rows = [(float(m), b) for m in sorted(set(masses)) for b in range(math.floor((m - tol) / width), math.floor((m + tol) / width) + 1)]
    wanted = points.sparkSession.createDataFrame(rows, "mass double, bucket long")
    near = points.where(F.col("mz").between(min(masses) - tol, max(masses) + tol))
    hit = near.withColumn("bucket", F.floor(F.col("mz") / width)).join(F.broadcast(wanted), "bucket")
    hit = hit.where((F.col("mz") >= F.col("mass") - tol) & (F.col("mz") <= F.col("mass") + tol))
    return _last_wins(hit.groupBy("mass", "spectrum_id", "x", "y").agg(F.max("intensity").alias("intensity")), "mass")


def candidates(stats: DataFrame, mz: float, tol: float) -> DataFrame:
    """Spectra whose m/z range meets the window."""
    return stats.where((F.lit(mz + tol) >= F.col("MinMZ")) & (F.lit(mz - tol) <= F.col("MaxMZ")))


def pruned(points: DataFrame, stats: DataFrame, masses: list[float], tol: float) -> DataFrame:
    """The points of the spectra whose m/z range meets the window of any mass: the union of the masses' candidates."""
    meets = [(F.lit(m + tol) >= F.col("MinMZ")) & (F.lit(m - tol) <= F.col("MaxMZ")) for m in masses]
    found = meets[0]
    for m in meets[1:]:
        found = found | m
    return points.join(stats.where(found).select(F.col("SpectrumID").alias("spectrum_id")), "spectrum_id", "left_semi")


def quantize_linear(image: DataFrame, levels: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``level``: intensity scaled to the image's maximum, halves to even."""
    tops = image.groupBy(*by).agg(F.max("intensity").alias("top"))
    rows, top = image.join(tops, list(by)) if by else image.crossJoin(F.broadcast(tops)), F.col("top")
    return rows.withColumn("level", F.when(top > 0, F.rint(F.greatest(F.lit(0.0), F.least(F.lit(levels - 1.0), F.col("intensity") * (levels - 1) / top)))).otherwise(0.0).cast("int")).drop("top")


def outlier_bounds(image: DataFrame, prob: float = 0.98, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., low, high): the upper bound that keeps ``prob`` of a histogram of 100 bins.

    Ranges below 99 use integer bins. The bin whose cumulative share is nearest to ``prob`` gives the edge; the
    bound is the largest intensity below it.
    """
    keys = list(by)
    base = image.groupBy(*keys).agg(F.min("intensity").alias("low"), F.max("intensity").alias("up"), F.count("*").alias("total"))
    rows = image.join(base, keys) if keys else image.crossJoin(F.broadcast(base))
    wide = F.col("up") - F.col("low") + 1 >= 100
    step = F.when(wide, (F.col("up") - F.col("low")) / 99).otherwise(1.0)
    start = F.when(wide, F.col("low")).otherwise(F.floor("low").cast("double"))
    binned = rows.select(*keys, "intensity", "total", step.alias("step"), start.alias("start")).withColumn("bin", F.floor((F.col("intensity") - F.col("start")) / F.col("step")))
    counts = binned.groupBy(*keys, "bin", "step", "start", "total").agg(F.count("*").alias("n"))
    share = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) / F.col("total")
    best = counts.withColumn("off", F.abs(F.lit(prob) - share)).groupBy(*keys).agg(F.min_by(F.struct("bin", "step", "start"), F.struct("off", "bin")).alias("b"))
    edge = best.select(*keys, (F.col("b.start") + (F.col("b.bin") + 1) * F.col("b.step")).alias("edge"))
    below = (image.join(edge, keys) if keys else image.crossJoin(F.broadcast(edge))).where("intensity < edge")
    high = below.groupBy(*keys).agg(F.max("intensity").alias("high"))
    return (base.join(high, keys, "left") if keys else base.crossJoin(F.broadcast(high))).select(*keys, "low", F.coalesce("high", "low").alias("high"))


def set_depth(image: DataFrame, bounds: DataFrame, depth: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``level`` between the bounds: the first of ``depth`` equal steps that reaches the intensity."""
    rows = image.join(bounds, list(by)) if by else image.crossJoin(F.broadcast(bounds))
    v, low, high = F.col("intensity"), F.col("low"), F.col("high")
    inner = F.ceil((v - low) / ((high - low) / (depth - 1)))
    level = F.when((low >= high) | (v <= low), 0).when(v >= high, depth - 1).otherwise(inner)
    return rows.withColumn("level", level.cast("int")).drop("low", "high")


def triq(image: DataFrame, depth: int = 256, prob: float = 0.98, by: tuple[str, ...] = ()) -> DataFrame:
    return set_depth(image, outlier_bounds(image, prob, by), depth, by)


def median3(image: DataFrame, value: str = "intensity") -> DataFrame:
    """The 3 x 3 median over the raster that spans the image; the border repeats, missing pixels are 0."""
    size = image.agg(F.max("x").alias("w"), F.max("y").alias("h"))
    grid = size.select("w", "h", F.explode(F.sequence(F.lit(1), "w")).alias("x")).select("w", "h", "x", F.explode(F.sequence(F.lit(1), "h")).alias("y"))
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    near = grid.select("w", "h", "x", "y", F.explode(steps).alias("dx")).select("w", "h", "x", "y", "dx", F.explode(steps).alias("dy"))
    near = near.select("x", "y", F.least("w", F.greatest(F.lit(1), F.col("x") + F.col("dx"))).alias("nx"), F.least("h", F.greatest(F.lit(1), F.col("y") + F.col("dy"))).alias("ny"))
    there = image.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col(value).alias("v"))
    return near.join(there, ["nx", "ny"], "left").groupBy("x", "y").agg(F.median(F.coalesce("v", F.lit(0))).alias(value))
