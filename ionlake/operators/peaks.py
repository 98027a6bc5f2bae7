"""Peaks: detection on points, selection, matching with references, binning over spectra."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionlake.operators.signal import EPS, noise, ordered
from ionlake.operators.tables import settled


def centroid_peaks(points: DataFrame, snr: float) -> DataFrame:
    """Centroids that exceed the noise by the ratio; each is its own peak."""
    rows = points.join(noise(points), "spectrum_id").withColumn("snr", F.col("intensity") / (F.col("noise") + EPS))
    return rows.where(F.col("snr") >= snr).select("spectrum_id", "pos", "mz", "intensity", F.lit(0.0).alias("fwhm"), F.lit(1.0).alias("shape_r2"), "snr", F.col("intensity").alias("prominence"))


def peak_candidates(points: DataFrame, half: int, snr: float, prominence: float) -> DataFrame:
    """Interior local maxima above noise that rise over the lowest point on either side by a share of their height."""
    frame, n = ordered().rowsBetween(-half, half), F.count("*").over(Window.partitionBy("spectrum_id"))
    rows = points.join(noise(points), "spectrum_id").select(
        "*", F.max("intensity").over(frame).alias("top"), F.min("intensity").over(ordered().rowsBetween(-half, 0)).alias("left"), F.min("intensity").over(ordered().rowsBetween(0, half)).alias("right"),
        F.row_number().over(ordered()).alias("rank"), n.alias("n"),
    )
    i = F.col("intensity")
    return rows.where((F.col("rank") > 1) & (F.col("rank") < F.col("n")) & (i >= F.col("top")) & (i > snr * (F.col("noise") + EPS)) & (i - F.greatest("left", "right") > prominence * i)).select("spectrum_id", "pos", "mz", "intensity")


def select_peaks(peaks: DataFrame, min_snr: float = 0.0, min_fwhm: float = 0.0, max_fwhm: float = float("inf"), min_r2: float = 0.0) -> DataFrame:
    return peaks.where((F.col("snr") >= min_snr) & F.col("fwhm").between(min_fwhm, max_fwhm) & (F.col("shape_r2") >= min_r2))


def top_peaks(peaks: DataFrame, n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("spectrum_id").orderBy(F.desc("intensity"), "mz", "pos"))
    return peaks.withColumn("rank", rank).where(F.col("rank") <= n)


def matches(peaks: DataFrame, references: list[float], ppm: float) -> DataFrame:
    """(spectrum_id, reference, mz, ppm): of every spectrum the peak nearest to each reference within the tolerance, the first of equals.

    The references are a list in memory; each meets only the m/z buckets that its tolerance touches.
    """
    width = max(max(references) * ppm / 1e6 * 2, 1e-3)
    rows = [(float(r), b) for r in references for b in range(int((r - r * ppm / 1e6) // width), int((r + r * ppm / 1e6) // width) + 1)]
    wanted = peaks.sparkSession.createDataFrame(rows, "reference double, bucket long")
    hit = peaks.withColumn("bucket", F.floor(F.col("mz") / width)).join(F.broadcast(wanted), "bucket")
    off = F.abs(F.col("mz") - F.col("reference"))
    near = hit.where(off <= F.col("reference") * ppm / 1e6).groupBy("spectrum_id", "reference").agg(F.min_by("mz", F.struct(off, F.col("mz"), F.col("pos"))).alias("mz"))
    return near.withColumn("ppm", 1e6 * F.abs(F.col("mz") - F.col("reference")) / F.col("reference"))


def accuracy(matched: DataFrame, *by: str) -> DataFrame:
    ppm = F.col("ppm")
    return matched.groupBy(*by).agg(
        F.round(F.avg(ppm), 6).alias("mean_ppm"), F.round(F.median(ppm), 6).alias("median_ppm"), F.round(F.stddev_samp(ppm), 6).alias("std_ppm"), F.round(F.min(ppm), 6).alias("min_ppm"), F.round(F.max(ppm), 6).alias("max_ppm"), F.count("*").alias("n_matches")
    )


def regional_report(matched: DataFrame, by: str) -> DataFrame:
    """(by, mean_ppm, n_matches, range_of_means): errors by region, and the distance of the least and greatest finite mean."""
    each = matched.groupBy(by).agg(F.avg("ppm").alias("m"), F.count("*").alias("n_matches"))
    finite = F.when(~F.isnan("m"), F.col("m"))
    span = each.agg(F.round(F.max(finite) - F.min(finite), 6).alias("range_of_means"))
    return each.crossJoin(F.broadcast(span)).select(by, F.round("m", 6).alias("mean_ppm"), "n_matches", "range_of_means")


def adaptive_tolerance(matched: DataFrame) -> DataFrame:
    """Mean and three deviations, between 10 and 100 ppm; 20 without finite errors."""
    tol = F.greatest(F.lit(10.0), F.least(F.lit(100.0), F.avg("ppm") + 3 * F.stddev_samp("ppm")))
    return matched.agg(F.round(F.coalesce(F.nanvl(tol, F.lit(20.0)), F.lit(20.0)), 6).alias("tolerance_ppm"))


def chain_segments(peaks: DataFrame, tol: float, unit: str = "mz", width: float = 1.0) -> DataFrame:
    """Adds ``segment``: runs of peaks over all spectra in which none is further than the tolerance from the one before.

    Ranges of ``width`` m/z are sorted apart; the last m/z and the number of breaks of each range, one row a
    range, carry the chain across their borders. No task sees more than one range's peaks.
    """
    limit = F.lit(tol) if unit == "mz" else F.col("before") * tol / 1e6
    rows = peaks.withColumn("range", F.floor(F.col("mz") / width))
    ranges = rows.groupBy("range").agg(F.max("mz").alias("last")).withColumn("carry", F.lag("last").over(Window.orderBy("range")))
    inner = Window.partitionBy("range").orderBy("mz", "spectrum_id", "pos")
    joined = rows.join(ranges.select("range", "carry"), "range").withColumn("before", F.coalesce(F.lag("mz").over(inner), F.col("carry")))
    marked = joined.withColumn("breaks", F.when(F.col("before").isNull() | (F.col("mz") - F.col("before") > limit), 1).otherwise(0))
    marked = marked.withColumn("within", F.sum("breaks").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    sums = marked.groupBy("range").agg(F.sum("breaks").alias("b")).withColumn("offset", F.coalesce(F.sum("b").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return marked.join(sums.select("range", "offset"), "range").withColumn("segment", F.col("within") + F.col("offset")).select(*peaks.columns, "segment")


def bin_table(members: DataFrame, key: str, min_peaks: int = 1, max_width: float | None = None) -> DataFrame:
    """(bin, mz_lo, mz_hi, center, n): bins by order of m/z, without small and, by ppm of their centre, wide ones."""
    rows = members.groupBy(key).agg(F.min("mz").alias("mz_lo"), F.max("mz").alias("mz_hi"), F.avg("mz").alias("center"), F.count("*").alias("n")).where(F.col("n") >= min_peaks)
    return rows if max_width is None else rows.where((F.col("mz_hi") - F.col("mz_lo")) / F.col("center") * 1e6 <= max_width)


def features(members: DataFrame, key: str) -> DataFrame:
    """The feature matrix in long form: the largest intensity of each spectrum in each bin."""
    return members.groupBy("spectrum_id", key).agg(F.max("intensity").alias("value"))


def uniform_bins(peaks: DataFrame, n: int) -> DataFrame:
    """Adds ``bin`` of n equal bins between the least and greatest m/z, [lower, upper): the greatest itself has none."""
    span = peaks.agg(F.min("mz").alias("lo"), F.max("mz").alias("hi"))
    rows = peaks.crossJoin(F.broadcast(span)).withColumn("bin", (F.floor((F.col("mz") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / n)) + 1).cast("int"))
    return rows.where(F.col("bin") <= n).drop("lo", "hi")


def frequent(feature_rows: DataFrame, key: str, share: float, n_spectra: Column | int) -> DataFrame:
    """Bins with a positive value in at least the share of spectra, rounded up."""
    return feature_rows.where("value > 0").groupBy(key).agg(F.count("*").alias("present")).where(F.col("present") >= F.ceil(F.lit(share) * n_spectra))


#: Distinct m/z a range of ``anchor_bins`` aims at, and the most ranges there are.
AXIS_A_RANGE, MOST_RANGES = 1 << 16, 4096


def _limits(anchors: np.ndarray | float, tol: float, unit: str):
    return tol if unit == "mz" else anchors * tol / 1e6


def _next(mz: np.ndarray, tol: float, unit: str) -> np.ndarray:
    """For each of the ascending ``mz`` the first one beyond its tolerance, len(mz) if there is none."""
    limits = np.broadcast_to(_limits(mz, tol, unit), mz.shape)
    at, n = np.searchsorted(mz, mz + limits, side="right"), len(mz)
    padded = np.append(mz, np.inf)
    while (low := (at < n) & (padded[at] - mz <= limits)).any():  # sums round otherwise than differences
        at = at + low
    while (high := (at > 0) & (padded[at - 1] - mz > limits)).any():
        at = at - high
    return at


def _by_range(batches, columns: int):
    """(range, arrays) of rows that come sorted by range and m/z, one range at a time."""
    held, now = [], None
    for batch in batches:
        ranges = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and ranges[a] != now:
                yield now, [np.concatenate([h[c] for h in held]) for c in range(columns)]
                held = []
            now = int(ranges[a])
            held.append([batch.column(c + 1).to_numpy()[a:b] for c in range(columns)])
    if held:
        yield now, [np.concatenate([h[c] for h in held]) for c in range(columns)]


def _ranged(axis: DataFrame, bounds: list[float]) -> DataFrame:
    def run(batches):
        for batch in batches:
            ranges = np.searchsorted(np.array(bounds), batch.column(0).to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ranges), *batch.columns], names=["range", *batch.schema.names])

    return axis.mapInArrow(run, "range int, mz double, intensity double, n long").repartition("range").sortWithinPartitions("range", "mz")


def _steps(tol: float, unit: str):
    """What a range does to the anchor that comes in: for m/z up to ``upto`` as its first anchor, ``last`` is its last."""

    def run(batches):
        for number, (mz,) in _by_range(batches, 1):
            following, n = _next(mz, tol, unit), len(mz)
            last = np.where(following == n, np.arange(n), following)
            for _ in range(max(1, n.bit_length())):
                last = last[last]
            entries = last[: min(n, int(following[0]) + 1)]
            ends = np.append(np.flatnonzero(np.diff(entries)), len(entries) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), number, np.int32)), pa.array(mz[ends]), pa.array(mz[entries[ends]])], names=["range", "upto", "last"])

    return run


def _bins_of(carried: dict[int, float], tol: float, unit: str):
    """Sums a range contributes to each anchor, the one that comes in included."""

    def run(batches):
        for number, (mz, intensity, n) in _by_range(batches, 3):
            coming = carried[number]
            first = int(np.argmax(mz - coming > _limits(coming, tol, unit))) if (mz - coming > _limits(coming, tol, unit)).any() else len(mz)
            following, anchors, i = _next(mz, tol, unit), [], first
            while i < len(mz):
                anchors.append(i)
                i = int(following[i])
            starts = ([0] if first else []) + anchors
            names = ([coming] if first else []) + mz[anchors].tolist()
            sums = [np.add.reduceat(x, starts) for x in (mz * n, intensity, n)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.float64()), *[pa.array(x) for x in sums]], names=["anchor", "mz", "intensity", "n"])

    return run


def anchor_bins(peaks: DataFrame, tol: float, unit: str = "mz", min_peaks: int = 3) -> DataFrame:
    """(mz, intensity, n): a bin is opened by its first peak and takes those within the tolerance of it.

    Peaks of equal m/z share a bin, so they are first added up; what remains is the axis of distinct m/z, cut into
    ranges of about AXIS_A_RANGE. An anchor's successor is the first m/z beyond its tolerance; the last anchor of a range
    is all that the next one needs. A range is a step function of what comes in, a few rows; the chain through all
    ranges is found by doubling the pointers between those rows, and then all ranges are summed at once. A task holds one
    range's axis, never the peaks of a bin or chain.
    """
    axis = settled(peaks.where("mz is not null").groupBy("mz").agg(F.sum("intensity").alias("intensity"), F.count("*").alias("n")))
    count = axis.count()
    pieces = min(MOST_RANGES, -(-count // AXIS_A_RANGE))
    bounds = sorted(set(axis.approxQuantile("mz", [k / pieces for k in range(1, pieces)], 0.2 / pieces))) if pieces > 1 else []
    apart, least = [], -float("inf")
    for b in bounds:  # at most MOST_RANGES; two tolerances wide at least, so that a bin spans no whole range
        if b - least > 2 * _limits(b, tol, unit):
            apart.append(b)
            least = b
    ranged = settled(_ranged(axis, apart))
    carried = _carried(ranged, tol, unit) if apart else {0: -float("inf")}
    sums = ranged.select("range", "mz", "intensity", "n").mapInArrow(_bins_of(carried, tol, unit), "anchor double, mz double, intensity double, n long")
    bins = sums.groupBy("anchor").agg(F.sum("mz").alias("mz"), F.sum("intensity").alias("intensity"), F.sum("n").alias("n")).where(F.col("n") >= min_peaks)
    return bins.select((F.col("mz") / F.col("n")).alias("mz"), (F.col("intensity") / F.col("n")).alias("intensity"), "n")


def _carried(ranged: DataFrame, tol: float, unit: str) -> dict[int, float]:
    """The anchor that comes into each range, one number a range: none (-inf) where the range before has no anchor."""
    none = F.lit(-float("inf"))
    steps = settled(ranged.select("range", "mz").mapInArrow(_steps(tol, unit), "range int, upto double, last double"))
    order = {r["range"]: k for k, r in enumerate(ranged.select("range").distinct().orderBy("range").collect())}
    numbered = ranged.sparkSession.createDataFrame(list(order.items()), "range int, k int")
    steps = settled(steps.join(F.broadcast(numbered), "range").drop("range"))
    nodes = steps.select("k", "last").distinct().union(numbered.select("k", none))
    coming = nodes.select(F.col("k").alias("from_k"), F.col("last").alias("a"))
    limit = F.lit(tol) if unit == "mz" else F.col("a") * tol / 1e6
    beyond = F.when(F.col("upto") - F.col("a") > limit, F.struct("upto", "last"))
    jumps = coming.join(steps, F.col("k") == F.col("from_k") + 1).groupBy("from_k", "a").agg(F.min(beyond).alias("s")).select("from_k", "a", (F.col("from_k") + 1).alias("to_k"), F.coalesce("s.last", none).alias("b"))
    start = steps.where("k = 0").agg(F.min_by("last", "upto").alias("a")).select(F.lit(0).alias("k"), "a")
    jumps, seen, span = settled(jumps), settled(start), 1
    while span < len(order):
        there = seen.join(jumps, (F.col("k") == F.col("from_k")) & (seen["a"] == jumps["a"])).select(F.col("to_k").alias("k"), F.col("b").alias("a"))
        seen = settled(seen.union(there))
        on = jumps.select(F.col("from_k").alias("k2"), F.col("a").alias("a2"), F.col("to_k").alias("to2"), F.col("b").alias("b2"))
        jumps = settled(jumps.join(on, (F.col("to_k") == F.col("k2")) & (F.col("b") == F.col("a2"))).select("from_k", "a", F.col("to2").alias("to_k"), F.col("b2").alias("b")))
        span *= 2
    last = {r["k"]: r["a"] for r in seen.collect()}  # one row a range
    return {number: last[k - 1] if k else -float("inf") for number, k in order.items()}
