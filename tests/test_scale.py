"""Operators that must not gather: against plain loops, with limits set so low that every way is taken."""

import math
import random

import numpy as np
import pytest

from ionlake.functions import images
from ionlake.operators import peaks, quantiles, regions, surfaces


def folded(rows, tol, unit, least):
    out, anchor, held = [], None, []
    for mz, intensity in [*sorted(rows), (None, None)]:
        if mz is not None and anchor is not None and mz - anchor <= (tol if unit == "mz" else anchor * tol / 1e6):
            held.append((mz, intensity))
            continue
        if len(held) >= least:
            out.append((round(sum(h[0] for h in held) / len(held), 9), round(sum(h[1] for h in held) / len(held), 6), len(held)))
        anchor, held = mz, [(mz, intensity)]
    return out


AXES = {
    "dense": [100 + k * 0.013 for k in range(700)],
    "grid": [100 + k / 64 for k in range(500)] * 2,
    "gaps": [100 + k * 0.01 + 7 * (k // 90) for k in range(600)],
    "clusters": [100.0 + 5 * (k % 9) + 1e-4 * (k // 9) for k in range(500)],
    "one": [250.0] * 40,
}


@pytest.mark.parametrize("name", AXES)
@pytest.mark.parametrize(("tol", "unit"), [(0.05, "mz"), (1 / 16, "mz"), (300.0, "ppm"), (2.0, "mz")])
def test_anchor_bins_equal_a_fold(spark, monkeypatch, name, tol, unit):
    monkeypatch.setattr(peaks, "AXIS_A_RANGE", 25)
    r = random.Random(len(name))
    rows = [(mz, float(r.randint(1, 99))) for mz in AXES[name]]
    made = spark.createDataFrame([(k, k % 7, mz, i) for k, (mz, i) in enumerate(rows)], "pos long, spectrum_id long, mz double, intensity double")
    got = sorted((round(x["mz"], 9), round(x["intensity"], 6), x["n"]) for x in peaks.anchor_bins(made, tol, unit, 2).collect())
    assert got == folded(rows, tol, unit, 2)


def test_anchor_bins_of_nothing(spark):
    assert peaks.anchor_bins(spark.createDataFrame([], "pos long, spectrum_id long, mz double, intensity double"), 0.1).count() == 0


def test_quantiles_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 3)
    monkeypatch.setattr(quantiles, "BINS", 16)
    r = random.Random(2)
    rows = [(None if k % 5 == 0 else k % 3, r.choice([r.gauss(0, 1), 10.0 ** r.randint(-200, 200), 1.5, -2.0])) for k in range(400)]
    rows += [(7, 3.0)] * 50 + [(8, None), (9, float("nan")), (9, 2.0), (10, 1.0), (10, 2.0)]
    made = spark.createDataFrame(rows, "g int, v double")
    for q in (0.5, 0.0, 1.0, 0.3):
        got = {x["g"]: x["m"] for x in quantiles.quantiles(made, ["g"], "v", q, "m").collect()}
        want = {g: float(np.quantile([v for k, v in rows if k == g and v is not None and not math.isnan(v)], q)) for g in (None, 0, 1, 2, 7, 9, 10)}
        assert set(got) == set(want) and all(math.isclose(got[g], want[g], rel_tol=1e-12, abs_tol=1e-300) for g in want)
    assert quantiles.quantiles(made, [], "v").collect()[0]["value"] == float(np.median([v for _, v in rows if v is not None and not math.isnan(v)]))
    assert [r["value"] for r in quantiles.quantiles(made.limit(0), [], "v").collect()] == [None] and quantiles.quantiles(made.limit(0), ["g"], "v").count() == 0


def raster(spark, mask):
    return spark.createDataFrame([(int(x) + 1, int(y) + 1) for y, x in zip(*np.nonzero(mask), strict=True)], "x int, y int")


def matrix(frame, shape):
    out = np.zeros(shape, bool)
    for r in frame.collect():
        out[r["y"] - 1, r["x"] - 1] = True
    return out


@pytest.mark.parametrize("kind", ["noise", "spiral", "comb"])
def test_regions_equal_numpy(spark, kind):
    r = np.random.default_rng(4)
    mask = {"noise": r.random((23, 37)) < 0.55, "comb": np.indices((19, 31))[1] % 2 == 0, "spiral": np.zeros((21, 21), bool)}[kind]
    if kind == "comb":
        mask[-1] = True
    if kind == "spiral":
        for k in range(0, 10, 2):
            mask[k, k : 21 - k] = mask[21 - k - 1, k : 21 - k] = mask[k : 21 - k, 21 - k - 1] = True
            mask[k + 2 : 21 - k, k] = True
            mask[k + 2, k : k + 3] = True
    want, rows = images.label(mask), regions.regions(raster(spark, mask), 8).collect()
    assert len(rows) == mask.sum()
    names = {}
    for row in rows:
        names.setdefault((row["region_y"], row["region_x"]), set()).add(want[row["y"] - 1, row["x"] - 1])
    assert all(len(v) == 1 for v in names.values()) and len(names) == want.max()
    assert all(want[y - 1, x - 1] in v and not (want[: y - 1] == min(v)).any() for (y, x), v in names.items())


def test_region_of_interest_equals_numpy(spark):
    r = np.random.default_rng(8)
    y, x = np.mgrid[0:24, 0:33]
    image = np.exp(-((x - 15) ** 2 + (y - 11) ** 2) / 60) + 0.25 * r.random((24, 33))
    image[10:12, 14:16] = 0
    frame = spark.createDataFrame([(int(b) + 1, int(a) + 1, float(image[a, b])) for a in range(24) for b in range(33)], "x int, y int, intensity double")
    assert math.isclose(regions.otsu_threshold(frame).first()[0], images.otsu(image), rel_tol=1e-9)
    want = images.region_of_interest(image, noise=0.01, hole=0.02, size=3)
    got = regions.region_of_interest(frame, 33, 24, noise=0.01, hole=0.02, size=3)
    for step, mask in want.items():
        assert (matrix(got[step], (24, 33)) == mask).all(), step
    seed = regions.region_at(got["binary"], 16, 8)
    assert (matrix(seed, (24, 33)) == images.flood(want["binary"], (7, 15))).all()
    assert regions.region_at(got["binary"], 1, 1).count() in (0, int(images.flood(want["binary"], (0, 0)).sum()))
    flat = spark.createDataFrame([(1, 1, 2.0), (2, 1, 2.0)], "x int, y int, intensity double")
    assert regions.otsu_threshold(flat).first()[0] == 2.0 and regions.binarized(flat).count() == 2
    assert regions.regions(raster(spark, np.zeros((2, 2)))).count() == 0


@pytest.mark.parametrize("size", [2, 3, 5])
def test_closing_equals_numpy(spark, size):
    mask = np.random.default_rng(size).random((15, 18)) < 0.4
    assert (matrix(regions.closed(raster(spark, mask), size, 18, 15), mask.shape) == images.close(mask, size)).all()


def blurred(image, sigma):
    w, half = surfaces.weights(sigma), len(surfaces.weights(sigma)) // 2
    wide = np.pad(image, half, mode="edge")
    out = np.zeros(image.shape)
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            block, both = wide[y : y + 2 * half + 1, x : x + 2 * half + 1], np.outer(w, w)
            there = ~np.isnan(block)
            out[y, x] = (block[there] * both[there]).sum() / (both[there].sum() if not there.all() else 1)
    return out


def test_gaussian_in_tiles(spark):
    r = np.random.default_rng(6)
    image = r.random((29, 41))
    image[3, 5] = image[20:22, 30] = np.nan
    image[10:14, 7:9] = 0  # pixels without rows
    rows = [(x + 1, y + 1, float(image[y, x])) for y in range(29) for x in range(41) if not (10 <= y < 14 and 7 <= x < 9)]
    frame = spark.createDataFrame(rows, "x int, y int, intensity double")
    for sigma, tile in ((1.5, 10), (3.0, 16), (3.0, 256)):
        got = np.full(image.shape, -1.0)
        for p in surfaces.gaussian(frame, 41, 29, sigma, tile=tile).collect():
            got[p["y"] - 1, p["x"] - 1] = p["intensity"]
        assert np.allclose(got, blurred(image, sigma), atol=1e-12)
    mask = spark.createDataFrame([(x, y) for x in range(20, 25) for y in range(8, 10)], "x int, y int")
    cut = {(p["x"], p["y"]) for p in surfaces.surface(frame, 41, 29, mask=mask).collect()}
    assert cut == {(x, y) for x in range(1, 6) for y in range(1, 3)}
