"""Spectra as rows: access, statistics, aggregate spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionlake.schema import SpectrumNotFoundError


def spectrum_at(points: DataFrame, index: int) -> DataFrame:
    return points.where(F.col("spectrum_id") == index).select("pos", "mz", "intensity")


def coordinate_map(points: DataFrame) -> DataFrame:
    """(x, y, spectrum_id): where several spectra share a pixel the last one."""
    return points.groupBy("x", "y").agg(F.max("spectrum_id").alias("spectrum_id"))


def spectrum_at_pixel(points: DataFrame, x: int, y: int) -> DataFrame:
    there = points.where((F.col("x") == x) & (F.col("y") == y))
    return there.join(coordinate_map(there), ["x", "y", "spectrum_id"], "left_semi").select("spectrum_id", "pos", "mz", "intensity")


def require(found: DataFrame, what: str) -> DataFrame:
    if not found.head(1):
        raise SpectrumNotFoundError(what)
    return found


def first_n(points: DataFrame, n: int) -> DataFrame:
    """All points of the n spectra with the least ids."""
    return points.join(points.select("spectrum_id").distinct().orderBy("spectrum_id").limit(n), "spectrum_id", "left_semi")


def statistics(points: DataFrame, mode: Column | None = None) -> DataFrame:
    """Per spectrum: total ion current, base peak, number of points, range. The first of equal maxima is the base peak."""
    rows = points.withColumn("mode", F.lit("UNKNOWN") if mode is None else mode)
    return rows.groupBy(F.col("spectrum_id").alias("SpectrumID")).agg(
        F.round(F.sum("intensity"), 6).alias("TIC"),
        F.max("intensity").alias("BPI"),
        F.max_by("mz", F.struct("intensity", -F.col("mz"), -F.col("pos"))).alias("BasePeakMZ"),
        F.count("*").cast("int").alias("NumPoints"),
        F.min("mz").alias("MinMZ"),
        F.max("mz").alias("MaxMZ"),
        F.max("mode").alias("Mode"),
    )


def mz_range(points: DataFrame) -> DataFrame:
    return points.agg(F.min("mz").alias("min_mz"), F.max("mz").alias("max_mz"))


def total_spectrum(points: DataFrame, bins: int = 2000, span: DataFrame | None = None, mean: bool = False) -> DataFrame:
    """(bin, mz, intensity, n_spectra) on a uniform grid over the m/z range; empty bins are 0.

    The sums are partial aggregates of one row a bin; the range is one row. ``mean`` divides by the spectra,
    those without points in a bin included.
    """
    span = mz_range(points) if span is None else span
    counted = points.agg(F.countDistinct("spectrum_id").alias("n_spectra"))
    frame = span.crossJoin(counted)
    inv = (bins - 1) / (F.col("max_mz") - F.col("min_mz"))
    index = F.greatest(F.lit(1), F.least(F.lit(bins), F.floor((F.col("mz") - F.col("min_mz")) * inv + 1))).cast("int")
    sums = points.crossJoin(F.broadcast(span)).groupBy(index.alias("bin")).agg(F.sum("intensity").alias("s"))
    grid = frame.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "min_mz", "max_mz", "n_spectra")
    value = F.coalesce("s", F.lit(0.0)) / (F.col("n_spectra") if mean else F.lit(1))
    mz = F.col("min_mz") + (F.col("bin") - 1) * ((F.col("max_mz") - F.col("min_mz")) / (bins - 1))
    return grid.join(sums, "bin", "left").select("bin", F.round(mz, 6).alias("mz"), F.round(value, 6).alias("intensity"), "n_spectra")


def downsample(points: DataFrame, n: int) -> DataFrame:
    """At most n points a spectrum: the most intense of each of n equal m/z bins, bins without a positive one left out."""
    w = Window.partitionBy("spectrum_id")
    rows = points.select("*", F.min("mz").over(w).alias("lo"), F.max("mz").over(w).alias("hi"), F.count("*").over(w).alias("c"))
    bin_ = F.least(F.lit(n), F.floor((F.col("mz") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / n)) + 1)
    few, many = rows.where(f"c <= {n}").select("spectrum_id", "mz", "intensity"), rows.where(f"c > {n}")
    top = many.groupBy("spectrum_id", bin_.alias("bin")).agg(F.max_by(F.struct("mz", "intensity"), F.struct("intensity", -F.col("mz"), -F.col("pos"))).alias("t"))
    return few.union(top.select("spectrum_id", "t.mz", "t.intensity").where("intensity > 0"))


def metadata_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("n_spectra"),
        F.round(F.min("MinMZ"), 4).alias("min_mz"),
        F.round(F.max("MaxMZ"), 4).alias("max_mz"),
        F.round(F.avg("TIC"), 4).alias("mean_tic"),
        F.round(F.avg("BPI"), 4).alias("mean_bpi"),
        F.round(F.avg("NumPoints"), 4).alias("mean_points"),
        F.count_if(F.col("Mode") == "PROFILE").alias("n_profile"),
        F.count_if(F.col("Mode") == "CENTROID").alias("n_centroid"),
    )


def validate(spectra: DataFrame) -> DataFrame:
    """(spectrum_id, valid): non-empty, equally long, finite, not negative, m/z not decreasing."""
    sound = lambda x: (x >= 0) & ~F.isnan(x) & (x < float("inf"))
    mz = F.col("mz")
    rising = ~F.exists(F.sequence(F.lit(1), F.size(mz) - 1), lambda k: mz[k] < mz[k - 1])
    valid = (F.size(mz) > 0) & (F.size(mz) == F.size("intensity")) & F.forall(mz, sound) & F.forall("intensity", sound) & F.when(F.size(mz) > 1, rising).otherwise(True)
    return spectra.select("spectrum_id", valid.alias("valid"))


def quality(spectra: DataFrame) -> DataFrame:
    """(spectrum_id, empty, regular): without a finite intensity; with an m/z axis that does not decrease."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    mz = F.col("mz")
    falls = F.exists(F.sequence(F.lit(1), F.size(mz) - 1), lambda k: mz[k] < mz[k - 1])
    return spectra.select("spectrum_id", (~F.coalesce(F.exists("intensity", finite), F.lit(False))).alias("empty"), F.when(F.size(mz) > 1, ~falls).otherwise(True).alias("regular"))


def apply_spectra(spectra: DataFrame, function, schema: str) -> DataFrame:
    """A user's function of (spectrum_id, mz, intensity), numpy arrays, on every spectrum; it returns a tuple of ``schema`` or None.

    Spectra come in Arrow batches of bounded rows; nothing is gathered.
    """
    import pyarrow as pa

    empty = spectra.sparkSession.createDataFrame([], schema)
    types = [(f.name, f.dataType) for f in empty.schema.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        fields = pa.schema([(n, to_arrow_type(t)) for n, t in types])
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                mz, intensity = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                found = function(batch.column(0)[i].as_py(), mz, intensity)
                if found is not None:
                    out.append(found)
            columns = list(zip(*out, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return spectra.select("spectrum_id", "mz", "intensity").where("mz is not null and intensity is not null").mapInArrow(run, schema)


def iterate(spectra: DataFrame):
    """The spectra in order of their ids, one after another, a partition at a time on the driver."""
    yield from spectra.orderBy("spectrum_id").toLocalIterator()


def processed_total(points: DataFrame, bins: int = 2000, mean: bool = False) -> DataFrame:
    """The sum or mean spectrum of processed points, over their own range; an empty table gives an empty one."""
    return total_spectrum(points, bins, mean=mean)


def noise_hints(noise: DataFrame, resolution: float | None = None) -> DataFrame:
    """(noise, window): the mean of the positive finite noise levels, and a smoothing window by the instrument's resolution."""
    level = F.col("noise")
    usable = (level > 0) & ~F.isnan(level) & (level < float("inf"))
    window = 5 if resolution and resolution > 40000 else 7 if resolution and resolution > 10000 else 9
    return noise.agg(F.avg(F.when(usable, level)).alias("noise")).select("noise", F.lit(window).alias("window"))


def peak_characteristics(points: DataFrame) -> DataFrame:
    """(mean_points, median_points, total_points, n_spectra) over spectra that hold any."""
    counts = points.groupBy("spectrum_id").agg(F.count("*").alias("n"))
    return counts.agg(F.avg("n").alias("mean_points"), F.median("n").alias("median_points"), F.sum("n").alias("total_points"), F.count("*").alias("n_spectra"))


def peak_shapes(spectra: DataFrame, top: int = 3, snr: float = 3.0, half_window: int = 10) -> DataFrame:
    """(spectrum_id, n_peaks, fwhm_ppm, shape_r2): of each spectrum the means over its ``top`` most intense profile peaks.

    Widths count where a peak has one; a spectrum without peaks has nulls.
    """
    import numpy as np

    from ionlake.functions import kernels

    def shape(i, mz, y):
        sound = len(mz) == len(y) and np.isfinite(mz).all() and np.isfinite(y).all()
        found = sorted(kernels.detect_profile(mz, y, half_window, snr), key=lambda p: (-p[1], p[0]))[:top] if sound else []
        widths = [p[2] for p in found if p[2] > 0]
        return i, len(found), float(np.mean(widths)) if widths else None, float(np.mean([p[3] for p in found])) if found else None

    return apply_spectra(spectra, shape, "spectrum_id long, n_peaks int, fwhm_ppm double, shape_r2 double")


def shape_summary(shapes: DataFrame) -> DataFrame:
    """One row: mean and median width (ppm) and shape over the spectra that have them, and how many had peaks."""
    return shapes.agg(
        F.avg("fwhm_ppm").alias("mean_fwhm_ppm"), F.median("fwhm_ppm").alias("median_fwhm_ppm"), F.avg("shape_r2").alias("mean_r2"), F.median("shape_r2").alias("median_r2"),
        F.count_if(F.col("n_peaks") > 0).alias("n_spectra"),
    )


def dimensions(points: DataFrame) -> DataFrame:
    """One row: the raster's width and height, and the pixels that have a spectrum."""
    return points.agg(F.max("x").alias("width"), F.max("y").alias("height"), F.count_distinct("x", "y").alias("n_pixels"))


def dynamic_range(points: DataFrame) -> DataFrame:
    """One row: orders of magnitude between the least positive and the greatest intensity."""
    positive = F.when(F.col("intensity") > 0, F.col("intensity"))
    return points.agg(F.round(F.log10(F.max(positive) / F.min(positive)), 6).alias("orders"))
