"""Vector codes, the web archive and importance resampling against plain loops, awkward tables and damaged files."""

import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.llm import resampling, vector_codes, web_archive
from ionlake.llm.common import Scratch, shared_folder

# op11


def plain_codes(rows):
    """(vec_id, label, values) to (vec_id, code, error, label_error, digest) by loops, all vectors of one length."""
    kept = sorted((r for r in rows if r[2] and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-len(kept[0][2]) // 16)
    split = lambda v: [[math.floor(256 * x) for x in (v + [0.0] * (16 * width - len(v)))[p * width : (p + 1) * width]] for p in range(16)]
    parts = [split(list(r[2])) for r in kept]
    book = [[parts[k][p] for k in range(min(64, len(parts)))] for p in range(16)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: [min(range(len(book[p])), key=lambda j: (square(v[p], book[p][j]), j)) for p in range(16)]
    for _ in range(2):
        codes = [nearest(v) for v in parts]
        for p in range(16):
            for j in range(len(book[p])):
                mine = [v[p] for v, c in zip(parts, codes, strict=True) if c[p] == j]
                if mine:
                    book[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = [nearest(v) for v in parts]
    errors = [sum(square(v[p], book[p][c[p]]) for p in range(16)) for v, c in zip(parts, codes, strict=True)]
    totals = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        totals[r[1]] += e
    digest = hashlib.sha256(",".join(str(x) for p in book for c in p for x in c).encode()).hexdigest()
    return Counter((r[0], "".join(f"{x:02x}" for x in c), e, totals[r[1]], digest) for r, c, e in zip(kept, codes, errors, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, code string, slot int")


def coded(spark, rows):
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.codes(vectors(spark, rows)).collect())


def test_codes_equal_plain_loops(spark):
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(32)] for _ in range(9)]
    rows = [(k, r.choice([None, 0, 1, 2]), [float(np.float32(x + r.gauss(0, 0.3))) for x in r.choice(centres)]) for k in range(300)]
    rows += [(900 + k, 1, [k % 3 / 256 - 1 / 256] * 32) for k in range(60)]  # many ties and equal rows
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(None, 5, [0.5] * 20), (None, 5, [0.25] * 20), (3, None, [-0.001] * 20), (3, None, [-0.001] * 20), (1, 7, [0.0] * 19 + [1e30]), (2, 7, [0.0] * 20)]
    rest = [(4, 1, None), (5, 1, []), (6, 1, [nan] * 20), (7, 1, [inf] + [0.0] * 19), (8, 1, [None] + [0.0] * 19), (9, 1, [1.0] * 8)]
    got = coded(spark, sound + rest)
    clipped = [(i, label, [min(x, vector_codes.LARGEST / 256) for x in v]) for i, label, v in sound]
    assert got == plain_codes(clipped) and sum(got.values()) == 6
    assert coded(spark, rest[:5]) == Counter() and coded(spark, []) == Counter()
    assert vector_codes.codes(vectors(spark, sound).drop("label")).count() == 6


def test_bounds_save_distances_and_hold():
    r = np.random.default_rng(3)
    numbers = (r.integers(-300, 300, (12, 16, 4))[r.integers(0, 12, 600)] + r.integers(-9, 9, (600, 16, 4))).astype(np.int32)
    before = numbers[:64].transpose(1, 0, 2).astype(np.int64)
    book = before + r.integers(-2, 3, before.shape)
    codes, upper, lower = vector_codes.assign(numbers, before)
    codes, upper, lower, computed = vector_codes.reassign(numbers, codes, upper, lower, book, before)
    true = vector_codes.distances(numbers, book)
    assert (codes == true.argmin(-1)).all()
    assert (lower <= 4 * np.sqrt(true) + 1e-6).all() and (upper >= 4 * np.sqrt(true.min(-1)) - 1e-6).all()
    assert computed < true.size / 3
    squares = np.array([0, 1, 2, 3, 4, (1 << 25) ** 2 - 1, (1 << 25) ** 2])
    assert vector_codes.floor_root(squares).tolist() == [math.isqrt(16 * int(s)) for s in squares]


def test_label_sums_by_join(spark, monkeypatch):
    rows = [(k, k % 5 if k % 7 else None, [float((k * j) % 11) for j in range(16)]) for k in range(80)]
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 2)
    assert coded(spark, rows) == plain_codes(rows)


# op12


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", b"y", 3) for r in rows], "page_id long, url string, html string, digest string, head binary, size int")


BIG = "<p>" + "ü word " * 40 + "</p>"


def test_archive_of_awkward_pages(spark):
    rows = [(5, "http://b/?q=1", BIG), (2, "http://a/", BIG), (9, None, BIG), (None, "http://c/", BIG), (2, "http://a/", BIG), (3, "u", "short"), (4, "u", "short"), (6, "u", ""), (7, "u\r\nWARC-Type: x", None), (8, "", BIG + "!"), (None, None, BIG + "!"), (10, "u", "\r\n\r\nWARC-Type: odd\r\n" * 9)]
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in web_archive.archived(pages(spark, rows)).collect())
    want, seen = Counter(), {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        first = seen.setdefault(digest, (page,))[0]
        revisit = len(data) >= 100 and digest in seen and seen[digest] != (page,) or want and len(data) >= 100 and any(w[2] == digest for w in want)
        want[page, len(data), digest, "revisit" if revisit else "response", first if revisit else None] += 1
    assert got == want
    assert web_archive.archived(pages(spark, [])).count() == 0


def test_payloads_are_stored_once_and_spread(spark, monkeypatch):
    monkeypatch.setattr(web_archive, "USES_A_KEY", 8)
    monkeypatch.setattr(web_archive, "HOT_KEYS", 4)
    folder = Scratch(spark, "t").root
    web_archive.store_pages(pages(spark, [(k, f"http://x/{k}", BIG if k % 3 else f"{BIG}{k}") for k in range(90)]), folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 31
    back = web_archive.restore(spark, folder).collect()
    assert len(back) == 90 and sum(r["record"].endswith(BIG.encode() + b"\r\n\r\n") for r in back) == 1
    assert Counter(r["record_type"] for r in web_archive.page_report(spark, folder).collect()) == {"response": 31, "revisit": 59}


def test_damage_is_noticed(spark):
    folder = Scratch(spark, "t").root
    web_archive.store_pages(pages(spark, [(1, "u", BIG), (2, "u", "other")]), folder)
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("body", F.concat("body", F.lit(b"!")))
    bad.write.parquet(f"{folder}/bad/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}/bad/headers")
    with pytest.raises(Exception, match="damaged payload"):
        web_archive.page_report(spark, f"{folder}/bad").collect()
    other = spark.createDataFrame([("d", 1, b"a"), ("d", 1, b"b")], "digest string, size int, body binary")
    with pytest.raises(Exception, match="different payloads"):
        web_archive.store_payloads(other, f"{folder}/clash")


def warc(*records):
    return b"".join(b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Length: %d\r\n%s\r\n%s\r\n\r\n" % (kind, len(block), extra, block) for kind, extra, block in records)


def test_files_come_back_byte_by_byte(spark, tmp_path):
    http = b"Content-Type: application/http; msgtype=response\r\n"
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + bytes(range(256))
    first = warc((b"warcinfo", b"", b"software: t\r\n"), (b"response", http, block), (b"metadata", b"x: y\r\n", b""))
    second = warc((b"response", http, block), (b"response", http, b"HTTP/1.1 204 No Content\r\n\r\n"))
    (tmp_path / "a.warc").write_bytes(first)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(second[:50]) + gzip.compress(second[50:]))
    (tmp_path / "c.warc").write_bytes(b"")
    folder = Scratch(spark, "t").root
    web_archive.store_records(web_archive.parse(spark.read.format("binaryFile").load(f"file://{tmp_path}/*.warc*")), folder)
    back = defaultdict(list)
    for r in web_archive.restore(spark, folder).orderBy("path", "seq").collect():
        back[r["path"].rsplit("/", 1)[-1]].append(bytes(r["record"]))
    assert {k: b"".join(v) for k, v in back.items()} == {"a.warc": first, "b.warc.gz": second}
    stored = [bytes(r["body"]) for r in spark.read.parquet(f"{folder}/payloads").collect()]
    assert stored.count(bytes(range(256))) == 1
    (tmp_path / "d.warc").write_bytes(second[:-20])
    with pytest.raises(Exception, match="cut off"):
        web_archive.parse(spark.read.format("binaryFile").load(f"file://{tmp_path}/d.warc")).collect()


# op13


def plain_draw(docs, target):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in low).split(" ")
        words = [w for w in words if w]
        return len(words), Counter(crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])])  # noqa: B905

    counted = [(d, *features(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in counted:
        s.update(c)
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for d, n, c in counted:
        size = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // size if size else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((k for k, r in enumerate(rows) if r[4] >= 20), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    rank = {k: i + 1 for i, k in enumerate(able[: 25 * len(able) // 100])}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(rows)]


def drawn(spark, docs, target):
    frame = spark.createDataFrame([(d, t, 1, 2, 3, "x") for d, t in docs], "doc_id long, text string, rank int, block int, counts int, score string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    return [tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in resampling.resample(frame, goal).collect()]


def test_draw_equals_plain_loops(spark):
    r = random.Random(5)
    words = ["Alpha", "beta", "gamma", "ünï", "漢字", "x1", "delta", "don't", "e f"]
    docs = [(k, " ".join(r.choice(words[: 3 + k % 7]) for _ in range(r.randrange(0, 60)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (None, "no id " * 9), (504, "Alpha beta " * 30000), (505, "\x85".join(["tail"] * 30))]
    target = ["beta gamma " * 20, None, "", "ünï 漢字 x1"]
    assert Counter(drawn(spark, docs, target)) == Counter(plain_draw(docs, target))


def test_equal_rows_have_ranks_of_their_own(spark):
    got = drawn(spark, [(1, "same words " * 12)] * 40 + [(None, "same words " * 12)] * 8, [])
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 13)) and len(got) == 48


def test_no_documents(spark):
    assert drawn(spark, [], ["a b"]) == [] and [r[4] for r in drawn(spark, [(1, "few words")], [])] == [None]


def test_blocks_are_sparse_rows(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "a")], "doc_id long, text string").coalesce(1)
    (block,) = resampling.matrix(docs, Scratch(spark, "t")).collect()
    assert block["doc_id"] == [1, 2, 3] and block["words"] == [3, 0, 1] and len(block["indptr"]) == 4
    a, b = crc32(b"a") % 10000, crc32(b"b") % 10000
    row = lambda k: dict(zip(block["indices"][block["indptr"][k] : block["indptr"][k + 1]], block["counts"][block["indptr"][k] :], strict=False))
    assert row(0)[b] == 2 and row(0)[a] == 1 and row(1) == {} and row(2) == {a: 1}
    assert shared_folder(spark)


def test_blocks_of_much_text_are_many_small_rows(spark):
    """One task's 3 MB of words, most of them new, come as rows and row groups that a task can hold many of."""
    r = random.Random(9)
    docs = [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(800))) for k in range(480)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    blocks = resampling.matrix(frame, Scratch(spark, "t"))
    sizes = [(len(b["doc_id"]), len(b["indices"])) for b in blocks.select("doc_id", "indices").collect()]
    assert sum(n for n, _ in sizes) == 480 and max(n for _, n in sizes) <= 50_000
    assert Counter(drawn(spark, docs, ["w1 w2 w3"])) == Counter(plain_draw(docs, ["w1 w2 w3"]))
