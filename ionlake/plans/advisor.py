"""Parameter recommendations from a few aggregates of a sample of spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.operators import peaks, signal, spectra


def sample_spectra(points: DataFrame, n: int = 100, seed: int = 1) -> DataFrame:
    """All points of n spectra, those with the least hash."""
    ids = points.select("spectrum_id").distinct().orderBy(F.xxhash64("spectrum_id", F.lit(seed)), "spectrum_id").limit(n)
    return points.join(ids, "spectrum_id", "left_semi")


def masked_sample(points: DataFrame, mask: DataFrame | None = None, indices: list[int] | None = None, n: int = 100) -> DataFrame:
    """The spectra that advice rests on: those of a list, or a sample of those under a mask, or of all."""
    chosen = points.join(mask, ["x", "y"], "left_semi") if mask is not None else points
    if indices:
        return chosen.where(F.col("spectrum_id").isin(indices))
    return sample_spectra(chosen, n)


def recommend(points: DataFrame, references: list[float] | None = None, mode: str = "PROFILE", sample: int = 100, mask: DataFrame | None = None, indices: list[int] | None = None) -> dict[str, dict]:
    """Parameters by step. The aggregates are one row each, whatever the size of the data.

    Widths and shapes are measured on the sampled spectra's highest peaks; where none has a width, 50 ppm stands in.
    """
    chosen = masked_sample(points, mask, indices, sample)
    quality = signal.signal_quality(chosen).first()
    hints = spectra.noise_hints(signal.noise(chosen)).first()
    profile = mode == "PROFILE"
    arrays = chosen.groupBy("spectrum_id").agg(F.sort_array(F.collect_list(F.struct("mz", "pos", "intensity"))).alias("p")).select("spectrum_id", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))
    shape = spectra.shape_summary(spectra.peak_shapes(arrays, half_window=3)).first() if profile else None
    step = chosen.withColumn("dm", F.col("mz") - F.lag("mz").over(signal.ordered())).agg(F.avg("dm").alias("step")).first()["step"] or 0.01
    error, spread = None, None
    if references:
        row = peaks.accuracy(peaks.matches(chosen, references, 50.0)).first()
        error, spread = (row["mean_ppm"], row["std_ppm"]) if row and row["n_matches"] else (None, None)
    tolerance = min(100.0, max(10.0, error + 3 * spread)) if error is not None and spread is not None else 20.0
    width_ppm = (shape["mean_fwhm_ppm"] if shape else None) or 50.0
    r2 = (shape["mean_r2"] if shape else None) or 0.0
    width = 500 * width_ppm / 1e6
    window = min(21, max(5, round(width / max(step, 1e-9)))) // 2 * 2 + 1
    needs = error is None or error > 20
    noise = hints["noise"] or 0.0
    return {
        "Stabilization": {"method": "sqrt"},
        "Smoothing": {"method": "savitzky_golay", "window": window, "order": 3 if window > 3 else 2},
        "BaselineCorrection": {"method": "snip" if profile else "none", "iterations": 100, "window": max(3, int(-(-width // max(step, 1e-9)) * 2))},
        "Normalization": {"method": "tic" if (quality["tic_cv"] or 0) < 0.3 else "rms"},
        "PeakPicking": {
            "method": "profile" if profile else "centroid", "snr": 3.0 if profile else 2.0, "half_window": max(-(-window // 2), 3) if profile else 2, "prominence": min(2 * noise, 0.005),
            "min_fwhm": 0.5 * width_ppm if profile else 0.0, "max_fwhm": 3 * width_ppm if profile else 200.0, "merge": tolerance / 2 if profile else 10.0, "min_r2": 0.8 * r2 if profile else 0.0,
        },
        "PeakSelection": {"min_snr": 3.0 if profile else 1.5, "min_fwhm": 0.5 * width_ppm if profile else 0.0, "max_fwhm": 2.5 * width_ppm if profile else 500.0, "min_r2": 0.8 * r2 if profile else 0.0},
        "Calibration": {"required": needs, "ppm": tolerance},
        "PeakAlignment": {"required": needs, "method": "lowess" if error is None or error > 30 else "linear", "tolerance": tolerance, "unit": "ppm"},
        "PeakBinning": {"tolerance": max(width_ppm / 2, tolerance), "unit": "ppm", "min_peaks": 3, "max_width": 3 * max(width_ppm / 2, tolerance)},
    }
