"""The kernels in SQL: array functions, formulas, and peak detection as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from ionlake.functions import kernels

#: Formulas that SQL expresses itself; Catalyst inlines them.
FORMULAS = {
    "ppm_error": "(measured DOUBLE, theoretical DOUBLE) RETURNS DOUBLE RETURN 1e6 * abs(measured - theoretical) / theoretical",
    "ppm_tolerance": "(mz DOUBLE, ppm DOUBLE) RETURNS DOUBLE RETURN mz * ppm / 1e6",
    "in_mz_window": "(mz DOUBLE, center DOUBLE, tol DOUBLE) RETURNS BOOLEAN RETURN mz BETWEEN center - tol AND center + tol",
    "stabilized": "(intensity DOUBLE, method STRING) RETURNS DOUBLE RETURN CASE method WHEN 'sqrt' THEN sqrt(greatest(0, intensity)) WHEN 'log1p' THEN log1p(greatest(0, intensity))"
    " WHEN 'log' THEN ln(greatest(2.220446049250313e-16, intensity)) WHEN 'log2' THEN log2(greatest(2.220446049250313e-16, intensity)) WHEN 'log10' THEN log10(greatest(2.220446049250313e-16, intensity)) ELSE intensity END",
}


def _arrays(kernel, *columns: pd.Series) -> pd.Series:
    """A kernel on the arrays of each row; a row with a null argument gives null."""
    return pd.Series([None if any(v is None for v in row) else kernel(*row).tolist() for row in zip(*columns, strict=True)])


def _functions() -> dict:
    y = lambda v: np.asarray(v, float)

    @pandas_udf("array<double>")
    def snip_baseline(intensity: pd.Series, rounds: pd.Series) -> pd.Series:
        return _arrays(lambda i, n: kernels.snip(y(i), int(n)), intensity, rounds)

    @pandas_udf("array<double>")
    def hull_baseline(mz: pd.Series, intensity: pd.Series) -> pd.Series:
        return _arrays(lambda m, i: kernels.hull(y(m), y(i)), mz, intensity)

    @pandas_udf("array<double>")
    def median_baseline(intensity: pd.Series, window: pd.Series) -> pd.Series:
        return _arrays(lambda i, n: kernels.moving_median(y(i), int(n)), intensity, window)

    @pandas_udf("array<double>")
    def savitzky_golay(intensity: pd.Series, window: pd.Series, degree: pd.Series) -> pd.Series:
        return _arrays(lambda i, n, d: kernels.savitzky_golay(y(i), int(n), int(d)), intensity, window, degree)

    @pandas_udf("array<double>")
    def moving_average(intensity: pd.Series, window: pd.Series) -> pd.Series:
        return _arrays(lambda i, n: kernels.moving_mean(y(i), int(n)), intensity, window)

    @pandas_udf("double")
    def mad_noise(intensity: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else kernels.mad(y(i)) for i in intensity], dtype=float)

    return {f.__name__ if hasattr(f, "__name__") else f._name: f for f in (snip_baseline, hull_baseline, median_baseline, savitzky_golay, moving_average, mad_noise)}


@udtf(returnType="spectrum_id bigint, pos bigint, mz double, intensity double, fwhm double, shape_r2 double, snr double, prominence double")
class DetectPeaks:
    """The peaks of every spectrum of a table argument with the columns spectrum_id, mz and intensity (arrays).

    ``method`` is profile, centroid or wavelet. Spectra that are null, empty, of unequal arrays, negative or not finite have no peaks.
    """

    def eval(self, spectrum, method: str = "profile", snr: float = 3.0, half_window: int = 10, prominence: float = 0.1, merge: float = 0.002) -> Iterator[tuple]:
        from ionlake.plans.preprocessing import Spectrum

        if spectrum["mz"] is None or spectrum["intensity"] is None:
            return
        one = Spectrum(spectrum["spectrum_id"], np.array(spectrum["mz"], float), np.array(spectrum["intensity"], float))
        if not one.sound():
            return
        if method == "centroid":
            found = kernels.detect_centroid(one.mz, one.intensity, float(snr))
        elif method == "wavelet":
            found = kernels.detect_wavelet(one.mz, one.intensity, float(snr))
        else:
            found = kernels.detect_profile(one.mz, one.intensity, int(half_window), float(snr), float(prominence), float(merge))
        for pos, p in enumerate(found):
            yield (int(one.id), pos, *map(float, p))


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL, under the names of ``FORMULAS`` and of the kernels, and ``detect_peaks``."""
    for name, body in FORMULAS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    for name, f in _functions().items():
        spark.udf.register(name, f)
    spark.udtf.register("detect_peaks", DetectPeaks)
