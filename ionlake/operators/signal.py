"""Point-wise and windowed signal operators on points, ordered by m/z and position within a spectrum."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ionlake.operators.quantiles import quantiles
from ionlake.operators.tables import settled

EPS = sys.float_info.epsilon
MAD_SCALE = 1.4826022185


def whole() -> WindowSpec:
    return Window.partitionBy("spectrum_id")


def ordered() -> WindowSpec:
    return whole().orderBy("mz", "pos")


def transform(method: str, value: str = "intensity") -> Column:
    """sqrt, log1p, log, log2, log10 of non-negative input; anything else leaves the value alone."""
    x = F.col(value)
    floor = F.greatest(F.lit(EPS), x)
    table = {"sqrt": F.sqrt(F.greatest(F.lit(0.0), x)), "log1p": F.log1p(F.greatest(F.lit(0.0), x)), "log": F.log(floor), "log2": F.log2(floor), "log10": F.log10(floor)}
    return table.get(method, x)


def normalized(points: DataFrame, method: str) -> DataFrame:
    """Intensities by total, median or root mean square of their spectrum; unchanged where that is not positive."""
    by = {"tic": F.sum("intensity"), "median": F.median("intensity"), "rms": F.sqrt(F.sum(F.col("intensity") * F.col("intensity")) / F.count("*"))}.get(method)
    if by is None:
        return points
    scale = points.groupBy("spectrum_id").agg(by.alias("scale"))
    return points.join(scale, "spectrum_id").withColumn("intensity", F.when(F.col("scale") > 0, F.col("intensity") / F.col("scale")).otherwise(F.col("intensity"))).drop("scale")


def pqn(points: DataFrame) -> DataFrame:
    """(spectrum_id, factor): the median quotient to the median spectrum, on the position axis.

    A position holds a value of every spectrum, so its median is selected by histograms; a spectrum's own quotients
    are as many as its points.
    """
    reference = quantiles(points, ["pos"], "intensity", name="ref")
    quotient = (F.col("intensity") + EPS) / (F.col("ref") + EPS)
    return points.join(reference, "pos").groupBy("spectrum_id").agg(F.median(quotient).alias("factor"))


def moving_average(points: DataFrame, window: int) -> DataFrame:
    """Centred mean, the frame cut at the ends; spectra shorter than the window stay as they are."""
    half = window // 2
    mean = F.avg("intensity").over(ordered().rowsBetween(-half, half))
    return points.withColumn("smooth", F.when(F.count("*").over(whole()) < window, F.col("intensity")).otherwise(mean))


def median_baseline(points: DataFrame, window: int) -> DataFrame:
    half = window // 2
    frame = F.sort_array(F.collect_list("intensity").over(ordered().rowsBetween(-half, half)))
    n = F.size(frame)
    base = (frame[F.floor((n - 1) / 2).cast("int")] + frame[F.floor(n / 2).cast("int")]) / 2
    return points.withColumn("baseline", F.when(F.count("*").over(whole()) < window, F.lit(0.0)).otherwise(base))


def snip(points: DataFrame, rounds: int) -> DataFrame:
    """Iterated clipping with radius 1: each value falls to the mean of its neighbours of the round before, the ends to their neighbour."""
    out = points.withColumn("baseline", F.col("intensity"))
    for _ in range(rounds):
        left, right = F.lag("baseline").over(ordered()), F.lead("baseline").over(ordered())
        middle = F.when(left.isNull(), right).when(right.isNull(), left).otherwise(0.5 * (left + right))
        out = out.select(*points.columns, F.least("baseline", F.coalesce(middle, F.col("baseline"))).alias("baseline"))
    return out


def smooth_quadratic5(points: DataFrame) -> DataFrame:
    """The five-point quadratic smoother where it has all its points."""
    at = lambda k: F.lag("intensity", -k).over(ordered()) if k else F.col("intensity")
    value = (-3 * at(-2) + 12 * at(-1) + 17 * at(0) + 12 * at(1) - 3 * at(2)) / 35
    return points.withColumn("smooth", value).where("smooth is not null")


def noise(points: DataFrame) -> DataFrame:
    """(spectrum_id, noise): the scaled median absolute deviation."""
    middle = points.groupBy("spectrum_id").agg(F.median("intensity").alias("m"))
    away = points.join(middle, "spectrum_id").withColumn("d", F.abs(F.col("intensity") - F.col("m")))
    return away.groupBy("spectrum_id").agg((F.median("d") * MAD_SCALE).alias("noise"))


def signal_quality(points: DataFrame) -> DataFrame:
    """One row: means of noise, of the 95th percentile of positive intensities over noise (at most 1e6), of totals and their spread."""
    high = points.groupBy("spectrum_id").agg(F.percentile(F.when(F.col("intensity") > 0, F.col("intensity")), 0.95).alias("q95"), F.sum("intensity").alias("tic"))
    rows = noise(points).join(high, "spectrum_id").withColumn("snr", F.least(F.lit(1e6), F.col("q95") / F.greatest(F.col("noise"), F.lit(1e-6))))
    rows = settled(rows)
    means = rows.agg(
        F.round(F.avg("noise"), 6).alias("mean_noise"), F.round(F.avg("snr"), 6).alias("mean_snr"), F.round(F.avg("tic"), 4).alias("mean_tic"), F.round(F.stddev_samp("tic") / F.avg("tic"), 6).alias("tic_cv"),
    )
    middle = quantiles(rows, [], "snr").agg(F.round(F.max("value"), 6).alias("median_snr"))
    return means.crossJoin(middle).select("mean_noise", "mean_snr", "median_snr", "mean_tic", "tic_cv")
