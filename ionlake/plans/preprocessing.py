"""Preprocessing as an ordered list of named steps; neighbouring kernel steps run in one pass over Arrow batches."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.functions import kernels
from ionlake.operators import peaks as peak_ops

PEAK_FIELDS = ("mz", "intensity", "fwhm", "shape_r2", "snr", "prominence")
SCHEMA = "spectrum_id long, x int, y int, mz array<double>, intensity array<double>, peaks array<struct<mz:double,intensity:double,fwhm:double,shape_r2:double,snr:double,prominence:double>>"


@dataclass
class Spectrum:
    id: int
    mz: np.ndarray
    intensity: np.ndarray
    peaks: list[tuple] = field(default_factory=list)

    def sound(self) -> bool:
        both = np.concatenate([self.mz, self.intensity])
        return bool(len(self.mz) and len(self.mz) == len(self.intensity) and np.isfinite(both).all() and (both >= 0).all() and (np.diff(self.mz) >= 0).all())


#: What a step's parameters may be, by step and name; the lowest and the highest value.
RANGES: dict[str, dict[str, tuple[float, float]]] = {
    "smoothing": {"window": (3, float("inf")), "order": (0, float("inf"))},
    "baseline_correction": {"iterations": (1, float("inf")), "window": (3, float("inf"))},
    "peak_picking": {"snr": (0, float("inf")), "half_window": (1, float("inf")), "prominence": (0, 1), "merge": (0, float("inf"))},
    "peak_selection": {"min_snr": (0, float("inf")), "min_fwhm": (0, float("inf")), "max_fwhm": (0, float("inf")), "min_r2": (0, 1)},
    "calibration": {"ppm": (0, float("inf")), "fit_order": (0, 2), "snr": (0, float("inf"))},
    "peak_alignment": {"tol": (0, float("inf"))},
    "peak_binning": {"tolerance": (0, float("inf")), "min_peaks": (1, float("inf"))},
}


def problems(name: str, params: dict) -> list[str]:
    """What is wrong with a step's parameters: everything at once, as the user has to mend it."""
    out = []
    for key, (low, high) in RANGES.get(name, {}).items():
        value = params.get(key)
        if value is None:
            continue
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            out.append(f"{key} is no number")
        elif not low <= value <= high:
            out.append(f"{key} out of range")
    if name == "calibration" and "references" in params and not params["references"]:
        out.append("no reference peaks")
    return out


@dataclass(frozen=True)
class Step:
    """A step's name and parameters, checked when it is made. A disabled step is not checked; an unknown one is left out with a warning."""

    name: str
    params: dict = field(default_factory=dict)
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.enabled and (wrong := problems(self.name, self.params)):
            raise ValueError(f"{self.name}: {', '.join(wrong)}")

    def known(self) -> bool:
        return self.name in KERNELS or self.name in ("peak_alignment", "peak_binning")


def _stabilize(s: Spectrum, method: str = "sqrt") -> None:
    y = s.intensity
    floor = np.maximum(kernels.EPS, y)
    s.intensity = {"sqrt": lambda: np.sqrt(np.maximum(0, y)), "log1p": lambda: np.log1p(np.maximum(0, y)), "log": lambda: np.log(floor), "log2": lambda: np.log2(floor), "log10": lambda: np.log10(floor)}.get(method, lambda: y)()


def _smooth(s: Spectrum, method: str = "savitzky_golay", window: int = 9, order: int = 2) -> None:
    if method in ("savitzky_golay", "sg"):
        s.intensity = np.maximum(0, kernels.savitzky_golay(s.intensity, window, order))
    elif method == "moving_average":
        s.intensity = np.maximum(0, kernels.moving_mean(s.intensity, window))


def _baseline(s: Spectrum, method: str = "snip", iterations: int = 100, window: int = 20, upper_hull: bool = False) -> None:
    """``convex_hull`` is the hull under the signal over m/z; ``upper_hull`` the one over it, over the points' places."""
    places = np.arange(len(s.intensity))
    table = {
        "snip": lambda: kernels.snip(s.intensity, iterations),
        "convex_hull": lambda: kernels.hull(places, s.intensity, False) if upper_hull else kernels.hull(s.mz, s.intensity),
        "median": lambda: kernels.moving_median(s.intensity, window),
    }
    base = table.get(method, lambda: 0.0)()
    s.intensity = np.maximum(0, s.intensity - base)


def _normalize(s: Spectrum, method: str = "tic") -> None:
    y = s.intensity
    by = {"tic": y.sum, "median": lambda: np.median(y), "rms": lambda: np.sqrt((y * y).mean())}.get(method, lambda: 1.0)()
    s.intensity = y / by if by > 0 else y


def _pick(s: Spectrum, method: str = "profile", snr: float = 3.0, half_window: int = 10, prominence: float = 0.1, merge: float = 0.002) -> None:
    if method == "centroid":
        s.peaks = kernels.detect_centroid(s.mz, s.intensity, snr)
    elif method == "wavelet":
        s.peaks = kernels.detect_wavelet(s.mz, s.intensity, snr)
    else:
        s.peaks = kernels.detect_profile(s.mz, s.intensity, half_window, snr, prominence, merge)


def _select(s: Spectrum, min_snr: float = 0.0, min_fwhm: float = 0.0, max_fwhm: float = float("inf"), min_r2: float = 0.0) -> None:
    s.peaks = [p for p in s.peaks if p[4] >= min_snr and min_fwhm <= p[2] <= max_fwhm and p[3] >= min_r2]


def _calibrate(s: Spectrum, references: tuple[float, ...] = (), ppm: float = 20.0, snr: float = 3.0) -> None:
    if references:
        found = np.array([p[0] for p in kernels.detect_profile(s.mz, s.intensity, snr=snr)])
        got, true = kernels.nearest_references(found, np.array(references), ppm)
        if len(got) >= 2:
            s.mz = kernels.piecewise(s.mz, np.sort(got), np.sort(true))  # each in its own order: the map never falls


def _align_to(s: Spectrum, reference: tuple[float, ...] = (), method: str = "linear", tol: float = 0.05, unit: str = "mz") -> None:
    if reference and s.peaks:
        s.mz, moved = kernels.align(s.mz, np.array([p[0] for p in s.peaks]), np.array(reference), method, tol, unit, seed=s.id)
        s.peaks = [(float(m), *p[1:]) for m, p in zip(moved, s.peaks, strict=True)]


KERNELS: dict[str, Callable] = {
    "stabilization": _stabilize,
    "smoothing": _smooth,
    "baseline_correction": _baseline,
    "normalization": _normalize,
    "peak_picking": _pick,
    "peak_selection": _select,
    "calibration": _calibrate,
}


def _peaks_in(column: pa.ListArray, i: int) -> list[tuple]:
    start, stop = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    fields = [column.values.field(k)[start:stop].to_pylist() for k in PEAK_FIELDS]
    return list(zip(*fields, strict=True))


def _listed(values: list, width: int | None = None) -> pa.ListArray:
    """A list column from one array a row, or, with ``width``, a column of lists of structs from tuples of so many numbers."""
    ends = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32))
    if width is None:
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values) if values else np.zeros(0)))
    flat = np.array([p for v in values for p in v], float).reshape(-1, width)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(width)], names=list(PEAK_FIELDS)))


def apply_kernels(spectra: DataFrame, steps: list[tuple[Callable, dict]]) -> DataFrame:
    """All steps on each spectrum in one pass over Arrow batches. Unsound spectra pass untouched, but have no peaks after peak picking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mz, intensity, found = [], [], []
            for i in range(batch.num_rows):
                axes = [c[i].values.to_numpy(zero_copy_only=False).astype(float) if c[i].is_valid else np.zeros(0) for c in batch.columns[3:5]]
                s = Spectrum(batch.column(0)[i].as_py(), *axes, _peaks_in(batch.column(5), i) if batch.column(5)[i].is_valid else [])
                for step, params in steps:
                    if s.sound():
                        step(s, **params)
                    elif step is _pick:
                        s.peaks = []
                mz.append(s.mz)
                intensity.append(s.intensity)
                found.append(s.peaks)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _listed(mz), _listed(intensity), _listed(found, len(PEAK_FIELDS))], names=["spectrum_id", "x", "y", "mz", "intensity", "peaks"])

    return spectra.select("spectrum_id", "x", "y", "mz", "intensity", "peaks").mapInArrow(run, SCHEMA)


def with_peaks(spectra: DataFrame) -> DataFrame:
    return spectra if "peaks" in spectra.columns else spectra.withColumn("peaks", F.array().cast(SCHEMA.split("peaks ")[1]))


def peak_rows(spectra: DataFrame) -> DataFrame:
    """One row a peak, numbered within its spectrum."""
    rows = spectra.select("spectrum_id", F.posexplode("peaks").alias("pos", "p"))
    return rows.select("spectrum_id", F.col("pos").cast("long").alias("pos"), *[F.col(f"p.{k}").alias(k) for k in PEAK_FIELDS])


#: Spectra that the search for a reference looks at first, and at most at once.
FIRST, MOST = 8, 4096


def alignment_reference(before: DataFrame, pending: list[tuple[Callable, dict]]) -> tuple[float, ...]:
    """The peaks' m/z of the first spectrum that has any after the pending steps: one spectrum's peaks reach the driver.

    Spectra are tried in order of their ids, more at a time as long as none has peaks, so the steps run over a few
    spectra here and over all of them only afterwards.
    """
    last, size = None, FIRST
    while True:
        some = (before if last is None else before.where(F.col("spectrum_id") > last)).orderBy("spectrum_id").limit(size)
        tried = apply_kernels(some, pending) if pending else some
        has = F.size("peaks") > 0
        row = tried.agg(F.min_by(F.when(has, F.col("peaks.mz")), F.when(has, F.col("spectrum_id"))).alias("mz"), F.max("spectrum_id").alias("last"), F.count("*").alias("n")).first()
        if row["mz"] or row["n"] < size:
            return tuple(row["mz"] or ())
        last, size = row["last"], min(MOST, size * 8)


def run_steps(spectra: DataFrame, steps: list[Step]) -> tuple[DataFrame, DataFrame | None]:
    """The spectra after all steps, and the binned features (mz, intensity, n) if binning is among them."""
    frame, pending, binned = with_peaks(spectra), [], None
    for step in [s for s in steps if s.enabled]:
        if not step.known():
            warnings.warn(f"unknown step {step.name} is left out", stacklevel=2)
        elif step.name in KERNELS:
            pending.append((KERNELS[step.name], step.params))
        elif step.name == "peak_alignment":
            reference = alignment_reference(frame, pending)
            pending.append((_align_to, {"reference": reference} | step.params))
        else:
            if pending:
                frame, pending = apply_kernels(frame, pending), []
            binned = peak_ops.anchor_bins(peak_rows(frame), step.params.get("tolerance", 0.05), step.params.get("unit", "mz"), step.params.get("min_peaks", 3))
    if pending:
        frame = apply_kernels(frame, pending)
    return frame, binned
