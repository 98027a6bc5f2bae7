"""Order-dependent signal kernels on numpy arrays of one spectrum; operators apply them in Arrow batches."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
MAD_SCALE = 1.4826022185


def mad(y: np.ndarray) -> float:
    return float(np.median(np.abs(y - np.median(y))) * MAD_SCALE) if len(y) else 0.0


def snip(y: np.ndarray, rounds: int) -> np.ndarray:
    b = y.astype(float)
    if len(b) < 2:
        return b
    for _ in range(rounds):
        middle = np.concatenate([[b[1]], (b[:-2] + b[2:]) / 2, [b[-2]]])
        b = np.minimum(b, middle)
    return b


def hull(x: np.ndarray, y: np.ndarray, lower: bool = True) -> np.ndarray:
    """The convex hull under (or over) the signal, by a monotone chain; zeros below three points."""
    if len(y) < 3:
        return np.zeros(len(y))
    turn, kept = (1 if lower else -1), []
    x, y = np.asarray(x, float), np.asarray(y, float)
    for i in range(len(x)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            cross = (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a])
            if turn * cross > 0:
                break
            kept.pop()
        kept.append(i)
    return np.interp(x, x[kept], y[kept])


def moving_median(y: np.ndarray, window: int) -> np.ndarray:
    if len(y) < window:
        return np.zeros(len(y))
    half = window // 2
    return np.array([np.median(y[max(0, i - half) : i + half + 1]) for i in range(len(y))])


def moving_mean(y: np.ndarray, window: int) -> np.ndarray:
    if len(y) < window:
        return y.astype(float)
    half, sums = window // 2, np.concatenate([[0.0], np.cumsum(y)])
    lo, hi = np.maximum(0, np.arange(len(y)) - half), np.minimum(len(y), np.arange(len(y)) + half + 1)
    return (sums[hi] - sums[lo]) / (hi - lo)


def savitzky_golay(y: np.ndarray, window: int, order: int) -> np.ndarray:
    """Least-squares smoothing; the ends are read off the polynomials of the first and last window. Even windows grow by one."""
    if window < 3 or order < 0 or order >= window:
        raise ValueError("the window must be 3 or more and exceed the order")
    window += 1 - window % 2
    if len(y) < window:
        return y.astype(float)
    half = window // 2
    fit = np.linalg.pinv(np.vander(np.arange(-half, half + 1), order + 1, increasing=True))
    out = np.convolve(y, fit[0][::-1], mode="same")
    ends = np.vander(np.arange(-half, half + 1), order + 1, increasing=True) @ fit
    out[:half] = (ends @ y[:window])[:half]
    out[-half:] = (ends @ y[-window:])[-half:]
    return out


def fwhm(x: np.ndarray, y: np.ndarray, i: int) -> float:
    """Width at half height between interpolated crossings; nan where a side has none."""
    level = y[i] / 2
    left = np.flatnonzero(y[:i] < level)
    right = np.flatnonzero(y[i + 1 :] < level)
    if not len(left) or not len(right):
        return float("nan")
    a, b = left[-1], i + 1 + right[0]
    lo = x[a] + (level - y[a]) * (x[a + 1] - x[a]) / (y[a + 1] - y[a])
    hi = x[b - 1] + (level - y[b - 1]) * (x[b] - x[b - 1]) / (y[b] - y[b - 1])
    return float(hi - lo)


def robust_fwhm(x: np.ndarray, y: np.ndarray, i: int, widest: float = 1.0) -> float:
    """The width at half height, nan for short spectra, peaks within two points of an end, and widths not between 0 and ``widest``."""
    if len(y) < 5 or i < 2 or i > len(y) - 3:
        return float("nan")
    width = fwhm(x, y, i)
    return width if np.isfinite(width) and 0 < width <= widest else float("nan")


def resolution(x: np.ndarray, y: np.ndarray, i: int) -> float:
    """m/z over the width at half height; nan without one."""
    width = robust_fwhm(x, y, i)
    return float(x[i] / width) if np.isfinite(width) else float("nan")


def gaussian_r2(x: np.ndarray, y: np.ndarray, i: int, half: int) -> float:
    """How well a Gaussian of the peak's height, place and width explains it; 0 without a width."""
    width = fwhm(x, y, i)
    if not np.isfinite(width) or width <= 0:
        return 0.0
    near = slice(max(0, i - half), i + half + 1)
    model = y[i] * np.exp(-0.5 * ((x[near] - x[i]) / (width / 2.355)) ** 2)
    total = ((y[near] - y[near].mean()) ** 2).sum()
    return 1.0 if total == 0 else float(max(0.0, 1 - ((y[near] - model) ** 2).sum() / total))


def detect_profile(x: np.ndarray, y: np.ndarray, half: int = 10, snr: float = 2.0, prominence: float = 0.1, merge: float = 0.002) -> list[tuple]:
    """(mz, intensity, fwhm ppm, shape R2, snr, prominence) of local maxima of the smoothed signal; close ones keep the higher."""
    if len(y) < 3:
        return []
    noise = mad(y) + EPS
    window = max(5, 2 * half + 1)
    ys = savitzky_golay(y, window, 2) if len(y) >= window else y.astype(float)
    high, low = (np.pad(ys, half, constant_values=v) for v in (-np.inf, np.inf))
    top = np.lib.stride_tricks.sliding_window_view(high, 2 * half + 1).max(axis=1)
    least = np.lib.stride_tricks.sliding_window_view(low, half + 1).min(axis=1)
    rise = ys - np.maximum(least[: len(ys)], least[half : half + len(ys)])
    inner = (np.arange(len(ys)) > 0) & (np.arange(len(ys)) < len(ys) - 1)
    found: list[int] = []
    for i in np.flatnonzero(inner & (ys >= top) & (ys > snr * noise) & (rise > prominence * ys)).tolist():
        if found and x[i] - x[found[-1]] < merge:
            if y[i] > y[found[-1]]:
                found[-1] = i
        else:
            found.append(i)
    out = []
    for i in found:
        width = fwhm(x, y, i)
        out.append((float(x[i]), float(y[i]), 1e6 * width / x[i] if np.isfinite(width) else 0.0, gaussian_r2(x, y, i, half), float(y[i] / noise), float(rise[i])))
    return out


def detect_centroid(x: np.ndarray, y: np.ndarray, snr: float = 3.0) -> list[tuple]:
    noise = mad(y) + EPS
    return [(float(a), float(b), 0.0, 1.0, float(b / noise), float(b)) for a, b in zip(x, y, strict=True) if b / noise >= snr]


def detect_wavelet(x: np.ndarray, y: np.ndarray, snr: float = 3.0, scales: tuple[int, ...] = (1, 2, 4, 8, 16)) -> list[tuple]:
    """Maxima over place and scale of a Morlet transform (by FFT, center frequency 5) that are local maxima above noise."""
    n = len(y)
    if n < 10:
        return []
    noise, omega, spectrum = mad(y) + EPS, 2 * np.pi * np.fft.fftfreq(2 * n), np.fft.fft(y, 2 * n)
    power = np.array([np.abs(np.fft.ifft(spectrum * np.exp(-0.5 * (s * omega - 5) ** 2) * (omega > 0) * np.sqrt(s)))[:n] for s in scales])
    out = []
    for i in range(1, n - 1):
        k = int(power[:, i].argmax())
        near = power[max(0, k - 1) : k + 2, i - 1 : i + 2]
        if power[k, i] >= near.max() and y[i] > y[i - 1] and y[i] > y[i + 1] and y[i] > snr * noise:
            out.append((float(x[i]), float(y[i]), 0.0, 1.0, float(y[i] / noise), float(y[i])))
    return out


def nearest_references(peaks: np.ndarray, references: np.ndarray, ppm: float) -> tuple[np.ndarray, np.ndarray]:
    """Measured and theoretical m/z of the peak nearest to each reference within the tolerance."""
    got = [(float(peaks[k]), float(r)) for r in references if len(peaks) and abs(peaks[k := int(np.abs(peaks - r).argmin())] - r) <= r * ppm / 1e6]
    return np.array([m for m, _ in got]), np.array([t for _, t in got])


def piecewise(x: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Linear between knots and on beyond them with the slope of the last piece; doubled knots count once."""
    knots, first = np.unique(knots, return_index=True)
    values = values[first]
    if len(knots) < 2:
        return x + (values[0] - knots[0] if len(knots) else 0.0)
    out = np.interp(x, knots, values)
    low, high = x < knots[0], x > knots[-1]
    out[low] = values[0] + (x[low] - knots[0]) * (values[1] - values[0]) / (knots[1] - knots[0])
    out[high] = values[-1] + (x[high] - knots[-1]) * (values[-1] - values[-2]) / (knots[-1] - knots[-2])
    return out


def match_sorted(reference: np.ndarray, target: np.ndarray, tol: float, unit: str = "mz", max_shift_ppm: float = 50.0) -> list[tuple[float, float]]:
    """Greedy one-to-one pairs of two sorted lists, both moving on at a match."""
    i = j = 0
    out = []
    while i < len(reference) and j < len(target):
        off = target[j] - reference[i]
        if abs(off) <= (tol if unit == "mz" else reference[i] * tol / 1e6):
            if abs(off) * 1e6 / reference[i] <= max_shift_ppm:
                out.append((reference[i], target[j]))
            i, j = i + 1, j + 1
        elif off < 0:
            j += 1
        else:
            i += 1
    return out


def lowess(x: np.ndarray, y: np.ndarray, span: float = 0.75) -> np.ndarray:
    """Local linear fits with tricube weights at the points themselves."""
    k = max(2, int(np.ceil(span * len(x))))
    out = np.empty(len(x))
    for i in range(len(x)):
        away = np.abs(x - x[i])
        reach = max(np.partition(away, k - 1)[k - 1], EPS)
        w = np.clip(1 - (away / reach) ** 3, 0, None) ** 3 + 1e-12
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        spread = np.average((x - mx) ** 2, weights=w)
        out[i] = my + (0 if spread < EPS else np.average((x - mx) * (y - my), weights=w) / spread * (x[i] - mx))
    return out


def align(mz: np.ndarray, peaks: np.ndarray, reference: np.ndarray, method: str = "linear", tol: float = 0.05, unit: str = "mz", seed: int = 0, max_shift_ppm: float = 50.0, least: int = 5):
    """The map of target m/z onto the reference's, applied to an axis and to peaks; the identity below ``least`` pairs."""
    pairs = match_sorted(np.sort(reference), np.sort(peaks), tol, unit, max_shift_ppm)
    if len(pairs) < least:
        return mz, peaks
    ref, got = (np.array(v) for v in zip(*pairs, strict=True))
    if method == "lowess":
        ref = lowess(got, ref)
    elif method == "ransac":
        rng, best = np.random.default_rng(seed), np.zeros(len(ref), dtype=bool)
        for _ in range(100):
            a, b = rng.choice(len(ref), 2, replace=False)
            if got[a] == got[b]:
                continue
            slope = (ref[b] - ref[a]) / (got[b] - got[a])
            off = np.abs(ref[a] + slope * (got - got[a]) - ref)
            inside = off <= (tol if unit == "mz" else ref * tol / 1e6)
            best = inside if inside.sum() > best.sum() else best
        if best.sum() >= 2:
            ref, got = ref[best], got[best]
    return piecewise(mz, got, ref), piecewise(peaks, got, ref)
