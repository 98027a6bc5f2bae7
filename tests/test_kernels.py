import numpy as np
import pytest

from ionlake.functions import images, kernels

RNG = np.random.default_rng(3)


def brute_snip(y, rounds):
    b = list(y)
    for _ in range(rounds):
        b = [min(b[i], (b[1] if i == 0 else b[-2] if i == len(b) - 1 else (b[i - 1] + b[i + 1]) / 2)) for i in range(len(b))]
    return np.array(b)


def test_snip_is_below_and_falls():
    y = RNG.random(60)
    assert np.allclose(kernels.snip(y, 7), brute_snip(y, 7))
    assert (kernels.snip(y, 9) <= kernels.snip(y, 3) + 1e-15).all() and (kernels.snip(y, 3) <= y).all()


def test_hulls_bound_the_signal():
    x, y = np.arange(50.0), RNG.random(50)
    assert (kernels.hull(x, y) <= y + 1e-12).all() and (kernels.hull(x, y, lower=False) >= y - 1e-12).all()
    assert (kernels.hull(x[:2], y[:2]) == 0).all()


def test_savitzky_golay_keeps_polynomials():
    x = np.arange(30.0)
    y = 2 + 3 * x - 0.1 * x**2
    assert np.allclose(kernels.savitzky_golay(y, 9, 2), y) and np.allclose(kernels.savitzky_golay(y, 8, 2), y)
    with pytest.raises(ValueError):
        kernels.savitzky_golay(y, 3, 3)


def test_moving_windows():
    y = RNG.random(21)
    assert np.allclose(kernels.moving_mean(y, 5), [y[max(0, i - 2) : i + 3].mean() for i in range(21)])
    assert (kernels.moving_median(y[:3], 5) == 0).all()


def test_gaussian_peak_is_found_whole():
    x = np.linspace(100, 110, 501)
    y = 5 * np.exp(-0.5 * ((x - 105) / 0.2) ** 2) + 0.001 * RNG.random(501)
    found = kernels.detect_profile(x, y, half=10, snr=3)
    best = max(found, key=lambda p: p[1])
    assert abs(best[0] - 105) < 0.03 and abs(best[2] - 1e6 * 0.471 / 105) < 100 and best[3] > 0.95
    assert any(abs(p[0] - 105) < 0.05 for p in kernels.detect_wavelet(x, y))


def test_alignment_with_itself_is_the_identity():
    mz = np.sort(RNG.uniform(100, 200, 40))
    for method in ("linear", "lowess", "ransac"):
        axis, moved = kernels.align(mz, mz, mz, method, tol=0.01)
        assert np.allclose(axis, mz, atol=1e-6) and np.allclose(moved, mz, atol=1e-6)
    axis, _ = kernels.align(mz, mz[:3], mz[:3])
    assert (axis == mz).all()


def test_shift_is_undone():
    mz = np.linspace(100, 200, 41)
    axis, _ = kernels.align(mz + 0.004, mz + 0.004, mz, "linear", tol=0.01)
    assert np.allclose(axis, mz)


def test_references_take_the_nearest():
    got, true = kernels.nearest_references(np.array([100.0, 100.001, 300.0]), np.array([100.0009, 200.0]), 20)
    assert got.tolist() == [100.001] and true.tolist() == [100.0009]


def test_images():
    a = np.zeros((9, 9))
    a[2:6, 2:6] = 1
    a[8, 8] = 1
    mask = images.region_of_interest(a, noise=0.03, hole=0.02)["smoothed"]
    assert mask[3, 3] and not mask[8, 8]
    assert images.label(a > 0).max() == 2 and images.flood(a > 0, (2, 2)).sum() == 16
    assert (images.shift(a > 0, 1, 0)[:, 1:] == (a > 0)[:, :-1]).all()
    assert images.turn(a > 0, 4).sum() == 17 and images.resize(a, 9, 9).tolist() == a.tolist()
    hole = np.ones((5, 5), bool)
    hole[2, 2] = False
    assert images.area_close(hole, 2).all() and images.close(hole, 3).all()
    assert images.disc(np.zeros((5, 5), bool), 3, 3, 2).sum() == 5
