"""The pipeline's steps, stored points, the SQL surface and the advisor."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.functions import kernels
from ionlake.operators import imaging, spectra, stored
from ionlake.operators.tables import numbered, own_folder
from ionlake.plans import advisor, preprocessing, sql
from ionlake.plans import queries as imaging_queries
from ionlake.plans.preprocessing import Step, run_steps

SF = "/root/testdata/sf0.001"


def test_candidates_read_their_blocks_only(spark, capsys):
    points = spark.range(4000).select((F.col("id") % 200).alias("spectrum_id"), (F.col("id") % 20).cast("int").alias("x"), F.lit(1).alias("y"), "id", F.col("id").alias("pos"), (F.col("id") % 200 + F.floor(F.col("id") / 200) / 100).alias("mz"), F.lit(1.0).alias("intensity")).drop("id")
    folder = own_folder(spark, "t")
    stored.store_points(points, folder, 20)
    assert stored.stats_of(spark, folder).count() == 200 and spark.read.parquet(f"{folder}/points").count() == 4000
    found = stored.candidate_points(spark, folder, [50.0, 150.0], 0.5)
    key = lambda f: sorted(map(str, f.select("spectrum_id", "mz").collect()))
    assert key(found) == key(points.where(imaging.in_window(50.0, 0.5) | imaging.in_window(150.0, 0.5)))
    found.explain("formatted")
    shown = capsys.readouterr().out
    assert "PartitionFilters: [block#" in shown and " IN (" in shown and "GreaterThanOrEqual(mz" in shown and "Aggregate" not in shown
    wanted = {r["block"] for r in stored.stats_of(spark, folder).where("SpectrumID in (49, 50, 149, 150)").select("block").collect()}
    assert spark.read.parquet(f"{folder}/points").where(F.col("block").isin(list(wanted))).count() <= 1000
    with_all = imaging.ion_images(found, [50.0, 150.0], 0.5)
    assert sorted(map(str, with_all.collect())) == sorted(map(str, imaging.ion_images(points, [50.0, 150.0], 0.5).collect()))
    assert stored.candidate_points(spark, folder, [5000.0], 0.5).count() == 0


def test_numbers_without_a_window(spark):
    rows = spark.range(5000).select((F.xxhash64("id") % 1000).alias("v"), "id").repartition(7)
    got = sorted((r["n"], r["v"]) for r in numbered(rows, [F.col("v").desc(), "id"], "n").collect())
    assert [n for n, _ in got] == list(range(1, 5001)) and [v for _, v in got] == sorted((v for _, v in got), reverse=True)
    assert numbered(rows.limit(0), ["v"], "n").count() == 0


def test_sql_names_the_kernels(spark):
    sql.register(spark)
    found = imaging_queries.QUERIES["sql_peaks"](spark, SF)
    want = imaging_queries.QUERIES["peaks_profile"](spark, SF)
    assert sorted(map(str, found.collect())) == sorted(str(r) for r in want.select(*found.columns).collect()) and found.count() > 0
    y = [float(v) for v in np.random.default_rng(2).random(30)]
    spark.createDataFrame([(1, [float(k) for k in range(30)], y), (2, None, None), (3, [], [])], "spectrum_id long, mz array<double>, intensity array<double>").createOrReplaceTempView("one_spectrum")
    row = spark.sql("select snip_baseline(intensity, 5) a, hull_baseline(mz, intensity) b, savitzky_golay(intensity, 7, 2) c, moving_average(intensity, 3) d, mad_noise(intensity) e, median_baseline(intensity, 5) f from one_spectrum order by spectrum_id").collect()
    v = np.array(y)
    for name, got in (("a", kernels.snip(v, 5)), ("b", kernels.hull(np.arange(30.0), v)), ("c", kernels.savitzky_golay(v, 7, 2)), ("d", kernels.moving_mean(v, 3)), ("f", kernels.moving_median(v, 5))):
        assert np.allclose(row[0][name], got) and row[1][name] is None
    assert row[0]["e"] == kernels.mad(v)
    assert spark.sql("select count(*) from detect_peaks(TABLE(one_spectrum), method => 'centroid', snr => 0.0)").first()[0] == 30
    plain = spark.sql("select ppm_error(100.001D, 100D), ppm_tolerance(200D, 5D), in_mz_window(1.5D, 1D, 0.5D), stabilized(9D, 'sqrt'), stabilized(-1D, 'log1p'), stabilized(3D, 'none')").first()
    assert np.allclose([float(x) for x in plain], [10.0, 0.001, 1, 3, 0, 3])


def test_steps_say_all_that_is_wrong():
    with pytest.raises(ValueError, match="snr out of range, half_window is no number, prominence out of range"):
        Step("peak_picking", {"snr": -1, "half_window": "x", "prominence": 2})
    for name, wrong in (("calibration", {"fit_order": 3}), ("calibration", {"references": ()}), ("peak_binning", {"min_peaks": 0}), ("peak_alignment", {"tol": -1.0}), ("peak_selection", {"min_r2": 1.5}), ("smoothing", {"window": 2})):
        with pytest.raises(ValueError, match=name):
            Step(name, wrong)
        Step(name, wrong, enabled=False)
    for low, high in ((r[0], r[1]) for ranges in preprocessing.RANGES.values() for r in ranges.values()):
        assert low < high


def profiles(spark, empty=0):
    x = 100 + 0.05 * np.arange(200)
    rows = [(k, 1, k, x.tolist(), [0.0] * 200 if k < empty else (np.exp(-0.5 * ((x - 104 - 0.002 * k) / 0.1) ** 2) + 0.5 * np.exp(-0.5 * ((x - 107) / 0.1) ** 2)).tolist()) for k in range(30)]
    return spark.createDataFrame(rows, "spectrum_id long, x int, y int, mz array<double>, intensity array<double>")


def test_unknown_steps_are_left_out(spark):
    steps = [Step("sharpening"), Step("stabilization"), Step("normalization", {"method": "tic"})]
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        frame, binned = run_steps(profiles(spark), steps)
    assert any("sharpening" in str(w.message) for w in caught) and binned is None
    assert all(abs(sum(r["intensity"]) - 1) < 1e-9 for r in frame.collect())


def test_the_reference_is_the_first_with_peaks(spark, monkeypatch):
    monkeypatch.setattr(preprocessing, "FIRST", 2)
    pick = (preprocessing._pick, {"snr": 1.0, "half_window": 3})
    before = preprocessing.with_peaks(profiles(spark, empty=21))
    found = preprocessing.alignment_reference(before, [pick])
    assert len(found) == 2 and abs(found[0] - 104.05) < 0.03 and abs(found[1] - 107) < 0.03
    assert preprocessing.alignment_reference(preprocessing.with_peaks(profiles(spark, empty=30)), [pick]) == ()
    assert preprocessing.alignment_reference(before.limit(0), [pick]) == ()


def test_baselines_by_name(spark):
    one = profiles(spark).limit(1)
    shown = {}
    for method, params in (("snip", {}), ("convex_hull", {}), ("convex_hull", {"upper_hull": True}), ("median", {"window": 5}), ("none", {})):
        frame, _ = run_steps(one, [Step("baseline_correction", {"method": method, **params})])
        shown[method, bool(params.get("upper_hull"))] = np.array(frame.first()["intensity"])
    y = np.array(one.first()["intensity"])
    assert (shown["none", False] == y).all() and (shown["convex_hull", True] == 0).all() and (shown["convex_hull", False] <= y).all() and (shown["snip", False] <= y).all()


def test_shapes_reach_the_advice(spark):
    shapes = spectra.peak_shapes(profiles(spark, empty=3), half_window=3)
    rows = {r["spectrum_id"]: r for r in shapes.collect()}
    assert rows[0]["n_peaks"] == 0 and rows[0]["fwhm_ppm"] is None and rows[5]["n_peaks"] == 2
    assert abs(rows[5]["fwhm_ppm"] - 1e6 * 0.2355 * (1 / 104 + 1 / 107) / 2) < 60 and rows[5]["shape_r2"] > 0.97
    summary = spectra.shape_summary(shapes).first()
    assert summary["n_spectra"] == 27 and summary["mean_r2"] > 0.95
    points = profiles(spark).select("spectrum_id", "x", "y", F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p")).select("spectrum_id", "x", "y", F.col("pos").cast("long").alias("pos"), "p.mz", "p.intensity")
    advice = advisor.recommend(points, [107.0])
    assert abs(advice["PeakPicking"]["min_fwhm"] / 0.5 - summary["mean_fwhm_ppm"]) < 60 and advice["PeakSelection"]["min_r2"] > 0.7
    mask = spark.createDataFrame([(1, 4), (1, 5)], "x int, y int")
    assert advisor.masked_sample(points, mask).select("spectrum_id").distinct().count() == 2
    assert [r[0] for r in advisor.masked_sample(points, indices=[7]).select("spectrum_id").distinct().collect()] == [7]
    assert advisor.recommend(points, mode="CENTROID")["PeakSelection"] == {"min_snr": 1.5, "min_fwhm": 0.0, "max_fwhm": 500.0, "min_r2": 0.0}
