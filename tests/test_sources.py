import base64
import struct
import zlib

import numpy as np
import pytest

from ionlake.plans import batch
from ionlake.schema import FileFormatError
from ionlake.sources import files
from ionlake.sources.mzml import index_offset
from ionlake.streaming import stats

SCHEMA = "spectrum_id long, x int, y int, native_id string, mode string, mz array<double>, intensity array<double>"


def raster(spark):
    rows = [(i + 1, i % 3 + 1, i // 3 + 1, "", "PROFILE", [100.0 + k for k in range(5)], [float(i * 10 + k) for k in range(5)]) for i in range(5)]
    return spark.createDataFrame([*rows, (6, 3, 2, "", "CENTROID", [], [])], SCHEMA)


@pytest.mark.parametrize("packing", ["none", "zlib"])
def test_imzml_round_trip(spark, tmp_path, packing):
    files.register(spark)
    path = str(tmp_path / "a.imzML")
    raster(spark).repartition(3).write.format("imzml").option("compression", packing).mode("append").save(path)
    back = files.open_dataset(spark, path, {2: "blank"})
    rows = {r["spectrum_id"]: r for r in back.collect()}
    assert len(rows) == 6 and rows[3]["mz"] == [100.0, 101.0, 102.0, 103.0, 104.0] and rows[3]["intensity"] == [20.0, 21.0, 22.0, 23.0, 24.0]
    assert rows[6]["mz"] == [] and rows[2]["sample_type"] == "blank" and rows[1]["sample_type"] == "sample" and rows[1]["mode"] == "PROFILE"
    assert [r["spectrum_id"] for r in back.where("x = 2 and y = 1").collect()] == [2]
    assert files.points_of(back).count() == 25
    assert [r["spectrum_id"] for r in spark.read.format("imzml").option("spectra", "2,4-5").load(path).orderBy("spectrum_id").collect()] == [2, 4, 5]


def write_mzml(path, spectra, indexed=True):
    out, offsets = "<mzML><run><spectrumList>\n", []
    for k, (time, mz, intensity, kind, packed) in enumerate(spectra):
        def block(values, axis, k=kind, z=packed):
            raw = struct.pack(f"<{len(values)}{'d' if k == 'MS:1000523' else 'f'}", *values)
            text = base64.b64encode(zlib.compress(raw) if z else raw).decode()
            return f'<binaryDataArray encodedLength="{len(text)}"><cvParam accession="{k}"/><cvParam accession="{"MS:1000574" if z else "MS:1000576"}"/><cvParam accession="{axis}"/><binary>{text}</binary></binaryDataArray>'

        offsets.append(len(out))
        out += f'<spectrum index="{k}" id="scan={k + 1}"><cvParam accession="MS:1000128"/><scan><cvParam accession="MS:1000016" value="{time}" unitName="minute"/></scan>{block(mz, "MS:1000514")}{block(intensity, "MS:1000515")}</spectrum>\n'
    out += "</spectrumList></run>\n"
    at = len(out)
    out += '<indexList count="1"><index name="spectrum">\n' + "".join(f'<offset idRef="scan={k + 1}">{o}</offset>\n' for k, o in enumerate(offsets)) + "</index></indexList>\n"
    path.write_text(out + (f"<indexListOffset>{at}</indexListOffset></mzML>" if indexed else "</mzML>"))


def test_mzml_and_conversion(spark, tmp_path):
    spectra = [(k / 600, [100.0, 101.0], [float(k), 1.0], "MS:1000523" if k % 2 else "MS:1000521", k % 3 == 0) for k in range(12)]
    path = tmp_path / "b.mzML"
    write_mzml(path, spectra)
    rows = files.open_dataset(spark, str(path)).orderBy("spectrum_id").collect()
    assert len(rows) == 12 and rows[5]["scan_time_ms"] == 500 and rows[5]["intensity"] == [5.0, 1.0] and rows[0]["mode"] == "PROFILE"
    sync = tmp_path / "sync.txt"
    sync.write_text("a\nb\n1,1,0\n2,1,200\n1,2,400\n2,2,600\n")
    pixels = files.read_sync(spark, str(sync))
    assert pixels.count() == 4
    target = str(tmp_path / "c.imzML")
    batch.convert(files.open_dataset(spark, str(path)), pixels, target)
    back = files.open_dataset(spark, target)
    assert {(r["x"], r["y"]) for r in back.collect()} == {(1, 1), (2, 1), (1, 2), (2, 2)}
    bad = tmp_path / "d.mzML"
    write_mzml(bad, spectra, indexed=False)
    with pytest.raises(FileFormatError):
        index_offset(str(bad))
    with pytest.raises(FileFormatError):
        files.open_dataset(spark, "x.raw")


def test_small_files(spark, tmp_path):
    image = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    files.write_png(image, str(tmp_path / "m.png"))
    assert np.allclose(files.read_png(str(tmp_path / "m.png")) * 255, image)
    files.write_bmp(image, str(tmp_path / "m.bmp"))
    data = (tmp_path / "m.bmp").read_bytes()
    assert data[:2] == b"BM" and len(data) == 1078 + 12 and data[1078 + 8] == 0 and data[1078 + 3] == 255
    registry = files.Registry(str(tmp_path / "r.json"))
    registry.update("a", has_mask=True)
    assert registry.update("a", mask_path="p") == {"has_mask": True, "mask_path": "p"}
    assert registry.reconcile({"b"}) == ({"b"}, {"a"})
    points = files.points_of(raster(spark))
    made = batch.image_files(points, [102.0], 0.1, str(tmp_path), "set.1", method="linear", median=True)
    assert made[0].endswith("set_1_102_0.bmp")
    with pytest.raises(ValueError):
        batch.parse_masses("100,x")


def test_stream_equals_batch(spark, tmp_path):
    points = files.points_of(raster(spark)).select("spectrum_id", "x", "y", "pos", "mz", "intensity")
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    query = stats.running_spectrum(stats.read_points(spark, str(tmp_path / "in")), 100, 104, 5).writeStream.format("memory").queryName("running").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    want = {(r["bin"], r["intensity"]) for r in stats.running_spectrum(points, 100, 104, 5).collect()}
    assert {(r["bin"], r["intensity"]) for r in spark.table("running").collect()} == want and len(want) == 5


def test_parameters_round_trip():
    from ionlake.plans import parameters
    from ionlake.plans.preprocessing import Step
    from ionlake.schema import FileFormatError

    steps = [Step("smoothing", {"window": 5}), Step("peak_picking", {"method": "profile", "snr": 8.0}, enabled=False), Step("peak_binning", {"tolerance": 0.05})]
    assert parameters.loads(parameters.dumps(steps, [(137.0244, "a")])) == (steps, [(137.0244, "a")])
    with pytest.raises(FileFormatError):
        parameters.standards([{"mz": 1.0}])


def test_instrument_of_mzml(tmp_path):
    from ionlake.sources import mzml

    path = tmp_path / "a.mzML"
    path.write_text('<mzML><instrumentConfiguration><cvParam cvRef="MS" accession="MS:1000031" name="model" value="X1"/><cvParam accession="MS:1000011" value="40000"/><cvParam accession="MS:1000130"/></instrumentConfiguration><processingMethod><cvParam accession="MS:1000580" name="smoothing"/></processingMethod><run><spectrumList><spectrum id="a"><cvParam accession="MS:1000129"/></spectrum></spectrumList></run></mzML>')
    found = mzml.instrument_metadata(str(path))
    assert (found.instrument_model, found.resolution, found.polarity, found.vendor_steps) == ("X1", 40000.0, "positive", ["Smoothing"])


def test_robust_widths():
    import numpy as np

    from ionlake.functions import kernels

    x = 100 + 0.01 * np.arange(41)
    y = np.exp(-0.5 * ((x - 100.2) / 0.03) ** 2)
    assert abs(kernels.robust_fwhm(x, y, 20) - 0.0706) < 0.002 and abs(kernels.resolution(x, y, 20) - 100.2 / 0.0706) < 40
    assert np.isnan(kernels.robust_fwhm(x, y, 1)) and np.isnan(kernels.robust_fwhm(x[:4], y[:4], 2)) and np.isnan(kernels.robust_fwhm(x, y, 20, widest=0.05))


def opened(frame):
    """What the scan of a frame read: partitions and rows."""
    return frame.rdd.getNumPartitions(), frame.count()


@pytest.fixture
def many(spark, tmp_path):
    rows = [(i + 1, i % 20 + 1, i // 20 + 1, "", "PROFILE", [100.0 + k for k in range(i % 7 + 1)], [float(i + k) for k in range(i % 7 + 1)]) for i in range(200)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), str(tmp_path / "m.imzML")


@pytest.mark.parametrize("compressed", [False, True])
def test_eight_tasks_write_one_file(spark, many, compressed):
    from ionlake.sources import imzml

    frame, path = many
    imzml.save(frame, path, compressed, parts=8)
    header, pixels = imzml.read_index(path)
    places = [(p.mz.offset, p.intensity.offset) for p in pixels]
    assert header["count"] == 200 and places == sorted(places) and places[0][0] == 16  # numbers in order, after the identity
    key = lambda f: sorted(map(str, f.select("spectrum_id", "x", "y", "mode", "mz", "intensity").collect()))
    assert key(files.open_dataset(spark, path)) == key(frame)
    with pytest.raises(FileExistsError):
        imzml.save(frame, path)
    imzml.save(frame.where("spectrum_id < 4"), path, compressed, overwrite=True)
    assert files.open_dataset(spark, path).count() == 3
    import glob
    import os

    assert sorted(os.path.basename(f) for f in glob.glob(f"{os.path.dirname(path)}/*")) == ["m.ibd", "m.imzML"]


def test_the_driver_moves_the_index_only(spark, many, monkeypatch):
    import json
    import pickle

    from ionlake.sources import imzml

    frame, path = many
    wide = frame.withColumn("mz", F_sequence(5000)).withColumn("intensity", F_sequence(5000))
    imzml.save(wide, path, parts=8)
    rows = [(1, 1, 1, "PROFILE", 5000, 0, 40000, 40000, 20000)] * 25
    assert len(pickle.dumps(imzml.Part("f", 0, 1, rows))) < 8000  # what one of 8 tasks sends for 1.5 MB of arrays
    target = str(many[1]).replace("m.imzML", "n.ibd")
    open(target, "wb").write(b"\0" * 16)
    short = imzml.ImzmlWriter(target.replace(".ibd", ".imzML"), True, False, json.dumps({"file": target, "identity": "0" * 32, "starts": {"0": [16, 8]}}))
    with pytest.raises(ValueError, match="larger than"):
        short.write(iter([{"spectrum_id": 1, "x": 1, "y": 1, "mode": "PROFILE", "mz": [1.0, 2.0], "intensity": [1.0, 2.0]}]))


def F_sequence(n):
    from pyspark.sql import functions as F

    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda v: v.cast("double"))


def test_lookups_open_one_partition(spark, many, monkeypatch):
    from ionlake.sources import imzml

    frame, path = many
    imzml.save(frame, path)
    monkeypatch.setattr(imzml, "PARTITION_BYTES", 200)  # of this process: the planner's workers read what the file says
    one = files.lookup(spark, path, "spectrum_id = 77")
    place = files.lookup(spark, path, "x = 3 and y = 4")
    assert one.rdd.getNumPartitions() == 1 and [r["spectrum_id"] for r in one.collect()] == [77]
    assert [r["spectrum_id"] for r in place.collect()] == [63]
    assert one.where("x = 99").count() == 0 and one.count() == 1 and place.count() == 1  # nothing of another plan stays
    assert one.join(files.lookup(spark, path, "spectrum_id in (77, 5)"), "spectrum_id").count() == 1
    assert files.lookup(spark, path, "y >= 10 and x < 3").count() == 2 and files.lookup(spark, path, "mode = 'PROFILE'").count() == 200
    assert files.open_dataset(spark, path).count() == 200 and files.lookup(spark, path, "spectrum_id = 999").count() == 0


def test_pushed_bounds_choose_bytes(spark, many):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    from ionlake.sources import imzml

    frame, path = many
    imzml.save(frame, path)
    for filters, want in (([EqualTo(("spectrum_id",), 7)], [7]), ([In(("x",), (1, 2)), LessThanOrEqual(("y",), 1)], [1, 2]), ([GreaterThan(("spectrum_id",), 198)], [199, 200])):
        reader = imzml.PushedReader(path)
        assert list(reader.pushFilters(filters)) == filters
        assert [p.spectrum_id for part in reader.partitions() for p in part.pixels] == want


def test_arrays_beyond_the_end(spark, many):
    from ionlake.sources import imzml

    frame, path = many
    imzml.save(frame, path)
    with open(imzml.ibd_of(path), "r+b") as file:
        file.truncate(2000)
    with pytest.raises(Exception, match="beyond the end"):
        files.open_dataset(spark, path).collect()
    assert files.lookup(spark, path, "spectrum_id = 1").count() == 1


def test_no_index_two_splits(spark, tmp_path):
    from ionlake.sources import mzml

    spectra = [(k / 600, [100.0 + i for i in range(k % 5)], [float(k)] * (k % 5), "MS:1000523", k % 3 == 0) for k in range(40)]
    write_mzml(tmp_path / "a.mzML", spectra)
    write_mzml(tmp_path / "b.mzML", spectra, indexed=False)
    size = (tmp_path / "b.mzML").stat().st_size
    key = lambda f: [tuple(r) for r in f.orderBy("spectrum_id").collect()]
    want = key(spark.read.format("mzml").load(str(tmp_path / "a.mzML")))
    for step in (size // 2 + 1, size // 7, 997, 10**9):
        cut = spark.read.format("mzml").option("splitBytes", step).load(str(tmp_path / "b.mzML"))
        assert key(cut) == want
        assert sum(1 for s in mzml.splits(str(tmp_path / "b.mzML"), step) for _ in mzml.records_between(s.path, s.start, s.stop)) == 40
    assert len(mzml.splits(str(tmp_path / "b.mzML"), size // 2 + 1)) == 2
    assert key(files.scan_times(spark, str(tmp_path / "a.mzML"))) == key(files.scan_times(spark, str(tmp_path / "b.mzML"))) == [(k + 1, round(k * 100)) for k in range(40)]
    assert [r[0] for r in key(files.lookup(spark, str(tmp_path / "a.mzML"), "spectrum_id between 5 and 7"))] == [5, 6, 7]
    assert [r[0] for r in key(files.lookup(spark, str(tmp_path / "b.mzML"), "spectrum_id in (5, 39)"))] == [5, 39]


def test_times_in_seconds(spark, tmp_path):
    write_mzml(tmp_path / "a.mzML", [(1.5, [1.0], [1.0], "MS:1000523", False)])
    text = (tmp_path / "a.mzML").read_text()
    (tmp_path / "s.mzML").write_text(text.replace('unitName="minute"', 'unitName="second"'))
    (tmp_path / "u.mzML").write_text(text.replace('unitName="minute"', 'unitAccession="UO:0000010"'))
    assert [files.scan_times(spark, str(tmp_path / f"{n}.mzML")).first()["scan_time_ms"] for n in "asu"] == [90000, 1500, 1500]
