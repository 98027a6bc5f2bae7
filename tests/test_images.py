"""Image files of all depths, masks from file to registry, wide matrices, the registry's lock."""

import multiprocessing
import os
import struct
import zlib

import numpy as np
import pytest

from ionlake.functions import bitmaps, images
from ionlake.schema import FileFormatError
from ionlake.sources import files
from ionlake.sources import images as image_files


def png(values, depth=8, colour=0, filters=(0,), laced=False, palette=None):
    """A PNG of samples [y, x, channel], rows filtered by turns."""
    height, width, n = values.shape
    step, body = max(1, n * depth // 8), b""
    for x0, y0, dx, dy in bitmaps.PASSES if laced else ((0, 0, 1, 1),):
        part = values[y0::dy, x0::dx]
        if not part.size:
            continue
        before = None
        for y, row in enumerate(part):
            bits = "".join(format(int(v), f"0{depth}b") for v in row.ravel())
            line = [int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)]
            before, how = before or [0] * len(line), filters[y % len(filters)]
            out = []
            for i, v in enumerate(line):
                a, b, c = (line[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
                p = a + b - c
                guess = (0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[how]
                out.append((v - guess) & 255)
            body += bytes([how, *out])
            before = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(body)
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(laced)))]
    parts += [chunk(b"PLTE", bytes(palette))] if palette else []
    parts += [chunk(b"IDAT", packed[:20]), chunk(b"IDAT", packed[20:]), chunk(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts)


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize(("depth", "colour"), [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (8, 2), (16, 2), (8, 4), (8, 6), (4, 3), (8, 3)])
def test_png_of_all_kinds(depth, colour, laced):
    r = np.random.default_rng(depth * 10 + colour)
    n = bitmaps.CHANNELS[colour]
    values = r.integers(0, 16 if colour == 3 else 1 << depth, (11, 13, n))
    palette = r.integers(0, 256, 48).tolist() if colour == 3 else None
    got = bitmaps.decode(png(values, depth, colour, (0, 1, 2, 3, 4), laced, palette))
    if colour == 3:
        want = np.array(palette).reshape(-1, 3)[values[:, :, 0]] @ bitmaps.LUMA / 255
    else:
        want = (values[:, :, :3] @ bitmaps.LUMA if colour in (2, 6) else values[:, :, 0]) / ((1 << depth) - 1)
    assert np.allclose(got, want)


def bmp(levels, depth, down=False):
    height, width = levels.shape
    palette = b"".join(bytes([v, v, v, 0]) for v in (range(256) if depth == 8 else range(0, 256, 17) if depth == 4 else (0, 255))) if depth <= 8 else b""
    body = b""
    for row in levels if down else levels[::-1]:
        line = b"".join(bytes([v] * 3 + [0] * (depth == 32)) for v in row) if depth > 8 else bytes(np.packbits(np.array([[int(b) for b in format(int(v), f"0{depth}b")] for v in row]).ravel()))
        body += line + b"\0" * (-len(line) % 4)
    start = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, -height if down else height, 1, depth, 0, len(body), 0, 0, 0, 0) + palette + body


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("depth", [1, 4, 8, 24, 32])
def test_bitmaps_of_all_depths(depth, down):
    top = {1: 1, 4: 15}.get(depth, 255)
    levels = np.random.default_rng(depth).integers(0, top + 1, (7, 9))
    assert np.allclose(bitmaps.decode(bmp(levels, depth, down)), levels / top)
    with pytest.raises(FileFormatError):
        bitmaps.decode(b"GIF89a")


def test_files_to_pixels(spark, tmp_path):
    r = np.random.default_rng(1)
    one, two = r.integers(0, 256, (5, 7)), r.integers(0, 2, (4, 3, 1))
    (tmp_path / "a.bmp").write_bytes(bmp(one, 8))
    (tmp_path / "b.png").write_bytes(png(two, 1))
    got = image_files.read(spark, [str(tmp_path / "a.bmp"), str(tmp_path / "b.png")]).collect()
    want = {("a.bmp", x + 1, y + 1, round(one[y, x] / 255, 9)) for y in range(5) for x in range(7)} | {("b.png", x + 1, y + 1, float(two[y, x, 0])) for y in range(4) for x in range(3)}
    assert {(os.path.basename(p["path"]), p["x"], p["y"], round(p["intensity"], 9)) for p in got} == want


def matrix(frame, shape):
    out = np.zeros(shape, bool)
    for p in frame.collect():
        out[p["y"] - 1, p["x"] - 1] = True
    return out


def test_mask_from_slice_to_registry(spark, tmp_path):
    y, x = np.mgrid[0:20, 0:26]
    levels = np.rint(255 * np.exp(-((x - 12) ** 2 + (y - 9) ** 2) / 40)).astype(int)
    files.write_bmp(levels, str(tmp_path / "slice.bmp"), bitmaps.palette_of(bitmaps.GRAY))
    steps = image_files.slice_mask(spark, str(tmp_path / "slice.bmp"), noise=0.01, hole=0.01)
    want = images.region_of_interest(levels / 255, noise=0.01, hole=0.01)
    assert all((matrix(steps[k], levels.shape) == want[k]).all() for k in want)
    registry = files.Registry(str(tmp_path / "registry.json"))
    registry.update("old", note="stays")
    path = image_files.save_mask(steps["smoothed"], 26, 20, str(tmp_path / "masks"), "set1", registry)
    entry = registry.load()["set1"]
    assert path.endswith("set1.png") and entry["has_mask"] and entry["mask_path"] == path and entry["is_imzML"] and entry["processed_date"]
    image_files.save_mask(steps["smoothed"], 26, 20, str(tmp_path / "masks"), "old", registry)
    assert registry.load()["old"]["note"] == "stays" and "is_imzML" not in registry.load()["old"]
    assert (matrix(image_files.dataset_mask(spark, registry, "set1", 26, 20), levels.shape) == want["smoothed"]).all()
    wide = image_files.dataset_mask(spark, registry, "set1", 52, 40)
    assert (matrix(wide, (40, 52)) == (images.resize(want["smoothed"], 40, 52) > 0.5)).all()
    assert image_files.dataset_mask(spark, registry, "none", 2, 2) is None
    os.remove(path)
    with pytest.raises(FileFormatError, match="missing"):
        image_files.dataset_mask(spark, registry, "set1", 26, 20)


def test_premade_masks_are_black_and_white(spark, tmp_path):
    two, soft, gray = np.array([[0, 200], [200, 0]]), np.array([[0, 10, 250], [255, 20, 240]]), np.array([[0, 128, 255]])
    for name, levels in (("two", two), ("soft", soft), ("gray", gray)):
        (tmp_path / f"{name}.bmp").write_bytes(bmp(levels, 8))
    assert {tuple(p) for p in image_files.premade_mask(spark, str(tmp_path / "two.bmp"), 2, 2).collect()} == {(2, 1), (1, 2)}
    assert {tuple(p) for p in image_files.premade_mask(spark, str(tmp_path / "soft.bmp"), 3, 2).collect()} == {(3, 1), (1, 2), (3, 2)}
    with pytest.raises(FileFormatError, match="3 gray levels"):
        image_files.premade_mask(spark, str(tmp_path / "gray.bmp"), 3, 1)


def test_resizing_equals_numpy(spark):
    image = np.random.default_rng(3).random((9, 14))
    frame = spark.createDataFrame([(x + 1, y + 1, float(image[y, x])) for y in range(9) for x in range(14)], "x int, y int, intensity double")
    for w, h in ((14, 9), (5, 7), (31, 20), (1, 1)):
        got = np.zeros((h, w))
        for p in image_files.resized(frame, w, h).collect():
            got[p["y"] - 1, p["x"] - 1] = p["intensity"]
        assert np.allclose(got, images.resize(image, h, w))
    assert image_files.size_of(image_files.downsampled(frame, 7)) == (7, 4) and image_files.bounded_size(300, 100, 512) == (300, 100)
    assert image_files.resized(frame.limit(0), 4, 4).count() == 0


def test_colours_and_ticks(spark, tmp_path):
    viridis = bitmaps.palette_of(bitmaps.VIRIDIS)
    assert len(viridis) == 256 and viridis[0] == 0x440154 and viridis[-1] == 0xFDE725 and bitmaps.palette_of(bitmaps.GRAY)[7] == 0x070707
    levels = np.arange(12).reshape(3, 4)
    files.write_bmp(levels, str(tmp_path / "v.bmp"), viridis)
    data = (tmp_path / "v.bmp").read_bytes()
    assert data[54:58] == bytes([0x54, 0x01, 0x44, 0])
    bar = image_files.colour_bar(spark, 0.0, 51000.0).orderBy("tick").collect()
    assert [b["value"] for b in bar] == [k * 10200.0 for k in range(6)] and bar[-1]["label"] == "51.00" and bar[0]["exponent"] == 3
    assert image_files.clicked(3.6, -2.4, 10, 5) == (4, -2) and image_files.clicked(-4, 3, 10, 5) == (1, -1) and image_files.clicked(99, -99, 10, 5) == (10, -5)


def test_wide_matrix(spark, tmp_path):
    long = spark.range(60_000).selectExpr("id % 3 as spectrum_id", "cast(id % 20000 as double) / 8 as mz", "cast(id as double) as value").where("mz <> 7 or spectrum_id <> 0")
    files.write_matrix(long, str(tmp_path / "m"))
    blocks = [d for d in os.listdir(tmp_path / "m" / "matrix") if d.startswith("block=")]
    assert len(blocks) == 20
    back = files.read_matrix(spark, str(tmp_path / "m")).selectExpr("cast(spectrum_id as long) as spectrum_id", "cast(mz as double) as mz", "cast(value as double) as value")
    assert back.count() == long.count() == back.join(long, ["spectrum_id", "mz", "value"], "left_semi").count()
    files.write_features(spark.createDataFrame([(101.25, 3.0), (100.5, 2.0)], "mz double, intensity double"), str(tmp_path / "f"))
    assert {tuple(r) for r in files.read_matrix(spark, str(tmp_path / "f/feature_matrix_standard"), "sample_type").collect()} == {("aggregated_spectrum", "100.5000", "2.0"), ("aggregated_spectrum", "101.2500", "3.0")}
    assert spark.read.csv(str(tmp_path / "f/feature_matrix_simple"), header=True).count() == 2


def _updates(path, name):
    for k in range(100):
        files.Registry(path).update(f"{name}{k % 10}", **{f"{name}{k}": k})


def test_no_update_is_lost(tmp_path):
    path = str(tmp_path / "r.json")
    workers = [multiprocessing.get_context("spawn").Process(target=_updates, args=(path, n)) for n in "ab"]
    for w in workers:
        w.start()
    for w in workers:
        w.join(60)
    entries = files.Registry(path).load()
    assert len(entries) == 20 and sum(len(e) for e in entries.values()) == 200 and os.listdir(tmp_path) == ["r.json"]


def test_locks_of_the_dead(tmp_path, monkeypatch):
    registry = files.Registry(str(tmp_path / "r.json"))
    (tmp_path / "r.json.lock").write_text("someone")
    monkeypatch.setattr(files.Registry, "RETRIES", 2)
    with pytest.raises(TimeoutError):
        registry.update("a", x=1)
    os.utime(tmp_path / "r.json.lock", (1, 1))
    assert registry.update("a", x=1) == {"x": 1} and os.listdir(tmp_path) == ["r.json"]
    with pytest.raises(ZeroDivisionError), registry.locked() as entries:
        entries["b"] = 1 / 0
    assert registry.load() == {"a": {"x": 1}}
