"""Small operators one by one: sync files, iteration, identities, calibration, flags, errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.operators import signal, spectra
from ionlake.plans.preprocessing import Step, run_steps
from ionlake.schema import SpectrumNotFoundError
from ionlake.sources import files

POINTS = "spectrum_id long, x int, y int, pos long, mz double, intensity double"


def points(spark):
    rows = [(i, i, 1, k, 100.0 + k, float(i * k)) for i in (3, 1, 2) for k in range(4)]
    return spark.createDataFrame(rows, POINTS)


def test_sync_lines_of_two_columns(spark, tmp_path):
    (tmp_path / "s.txt").write_text("head\nhead\n1, 0\n2, 150.7\n3, 300\n5, 600\n")
    got = {tuple(r) for r in files.read_sync(spark, str(tmp_path / "s.txt"), 3).collect()}
    assert got == {(1, 1, 0), (2, 1, 150), (3, 1, 300), (2, 2, 600)}


def test_spectra_one_after_another(spark):
    rows = points(spark).groupBy("spectrum_id").agg(F.count("*").alias("n")).repartition(3)
    assert [r["spectrum_id"] for r in spectra.iterate(rows)] == [1, 2, 3]
    with pytest.raises(SpectrumNotFoundError):
        spectra.require(spectra.spectrum_at(points(spark), 99), "99")
    assert spectra.require(spectra.spectrum_at(points(spark), 2), "2").count() == 4


def test_unknown_methods_leave_values_alone(spark):
    rows = points(spark)
    assert [r[0] for r in rows.select(signal.transform("none").alias("v")).collect()] == [r["intensity"] for r in rows.collect()]
    assert signal.normalized(rows, "none") is rows
    by = {m: {(r["spectrum_id"], r["pos"]): r["intensity"] for r in signal.normalized(rows, m).collect()} for m in ("tic", "median", "rms")}
    assert by["tic"][2, 3] == pytest.approx(6 / 12) and by["median"][2, 3] == pytest.approx(6 / 3) and by["rms"][2, 3] == pytest.approx(6 / np.sqrt((0 + 4 + 16 + 36) / 4))


def test_calibration_moves_the_axis(spark):
    x = 100 + 0.02 * np.arange(600)
    y = sum(np.exp(-0.5 * ((x - c) / 0.05) ** 2) for c in (102.004, 105.004, 109.004))
    frame = spark.createDataFrame([(1, 1, 1, x.tolist(), y.tolist()), (2, 1, 2, x.tolist(), [0.0] * 600)], "spectrum_id long, x int, y int, mz array<double>, intensity array<double>")
    got = {r["spectrum_id"]: np.array(r["mz"]) for r in run_steps(frame, [Step("calibration", {"references": (102.0, 105.0, 109.0), "ppm": 200.0})])[0].collect()}
    assert np.abs(got[1] - x).max() < 0.03 and np.abs(got[1][100:450] - (x[100:450] - 0.004)).max() < 0.012 and (got[2] == x).all()


def test_flags_of_spectra(spark):
    rows = [(1, [1.0, 2.0], [0.0, 1.0]), (2, [2.0, 1.0], [1.0, 1.0]), (3, [], []), (4, [1.0], [float("nan")]), (5, None, None), (6, [1.0, 1.0], [float("inf"), None])]
    got = {r["spectrum_id"]: (r["empty"], r["regular"]) for r in spectra.quality(spark.createDataFrame(rows, "spectrum_id long, mz array<double>, intensity array<double>")).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, True), 4: (True, True), 5: (True, True), 6: (True, True)}


def test_dimensions_and_orders(spark):
    assert tuple(spectra.dimensions(points(spark)).first()) == (3, 1, 3)
    assert spectra.dynamic_range(points(spark)).first()["orders"] == pytest.approx(np.log10(9), abs=1e-6)


def test_settled_tables_go_with_the_session(tmp_path):
    """In a process of its own: the tables are there while it runs and gone afterwards."""
    import os
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession\nimport os\nfrom ionlake.operators.tables import own_folder, settled\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "a = settled(s.range(5)); own_folder(s, 'x')\n"
        f"print(a.count(), sum('settled-' in d or 'x-' in d for d in os.listdir('{tmp_path}/shared')))\ns.stop()\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)
    assert out.stdout.split()[-2:] == ["5", "2"], out.stderr[-500:]
    assert not [d for d in os.listdir(tmp_path / "shared") if "settled-" in d or "x-" in d]


def test_inverse_of_a_tall_mask_is_whole(spark):
    """The raster goes on beyond row 999, where the range in mask_ops' SQL ends."""
    from ionlake.operators import imaging

    mask = spark.range(1, 1201).select(F.lit(1).alias("x"), F.col("id").cast("int").alias("y")).where("y % 3 <> 0").union(spark.createDataFrame([(2, 1200)], "x int, y int"))
    held = {tuple(r) for r in mask.collect()}
    assert {tuple(r) for r in imaging.mask_inverse(mask).collect()} == {(x, y) for x in (1, 2) for y in range(1, 1201)} - held
