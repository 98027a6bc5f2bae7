"""Awkward tables, brute force and exact round trips for the operators of the llm subpackage."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.llm import bpe, chaining, cover_tree, entropy_mix, graph, license_scan, line_dedup, media_chunks, minmax_dedup, style_tree, toxicity
from ionlake.llm.common import Scratch
from ionlake.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, rep string, of int, bucket int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


LONG = prose(1, 3000)
ROWS = [
    (0, prose(2, 80)), (1, prose(2, 80)), (2, prose(2, 79) + " changed"), (3, ""), (4, None), (5, "one"), (6, " \n\t "), (7, LONG),
    (8, LONG.replace("a", "b", 3)), (None, "no id here"), (9, "line a here is long enough\nline b\n\nline a here is long enough"), (9, "repeated id row"), (10, "Released under the MIT License."), (11, "ünïcödé   漢字 😀"),
]


def docs(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, [None, "en", "de"][k % 3], [None, "s1", "s2", ""][k % 4], None, k, "x", 1, 2) for k, (i, t) in enumerate(rows)], DOCS)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, path long, nodes int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(9)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def operators(spark, labels):
    toxic = lambda d: toxicity.score(d, toxicity.fit(d, labels, toxicity.Settings(epochs=1)))
    return {
        "license": lambda d: license_scan.scan(license_scan.document_files(d)),
        "media": media_chunks.media_table,
        "mix": entropy_mix.mix,
        "mixed": entropy_mix.mixed_documents,
        "lines": line_dedup.line_report,
        "deduplicated": line_dedup.deduplicated,
        "bpe": lambda d: bpe.round_trip(d, vocabulary()),
        "minmax": minmax_dedup.similar_documents,
        "chains": chaining.repeated_passages,
        "toxic": toxic,
    }


NAMES = ("license", "media", "mix", "mixed", "lines", "deduplicated", "bpe", "minmax", "chains", "toxic")


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, labels, name):
    got = operators(spark, labels)[name](docs(spark)).collect()
    if name not in ("chains", "mixed"):
        assert len(got) == len(ROWS)


def test_awkward_values(spark, labels):
    """What the awkward rows give, value by value, by each row's id and text."""
    import re

    run = operators(spark, labels)
    made = docs(spark).withColumn("k", F.coalesce("text", F.lit("<null>")))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    by_id = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))
    got = run["bpe"](made).collect()
    assert by_id((r["doc_id"], r["decoded_sha256"]) for r in got) == by_id((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert by_id((r["doc_id"], r["n_bytes"]) for r in run["media"](made).collect()) == by_id((i, len((t or "").encode())) for i, t in ROWS)
    assert by_id((r["doc_id"], r["size"]) for r in run["mix"](made).collect()) == by_id((i, len(words(t))) for i, t in ROWS)
    shingles = lambda t: len({tuple(w) for w in (zip(*(words(t)[k:] for k in range(5))) if len(words(t)) >= 5 else [words(t)] if words(t) else [])})  # noqa: B905, E731
    assert by_id((r["doc_id"], r["n_shingles"]) for r in run["minmax"](made).collect()) == by_id((i, shingles(t.lower() if t else t)) for i, t in ROWS)
    lines = lambda t: (t or "").split("\n")
    assert by_id((r["doc_id"], r["n_lines"], r["n_blank"]) for r in run["lines"](made).collect()) == by_id((i, len(lines(t)), sum(not x.strip(" \t\n\x0b\f\r") for x in lines(t))) for i, t in ROWS)
    scores = {}
    for r in run["toxic"](made).collect():
        scores.setdefault(r["doc_id"], []).append(r["score"])
    assert scores[0] == scores[1] and scores[3] == scores[4] and len(scores[9]) == 2 and all(0 <= x <= 1 for v in scores.values() for x in v)
    origins = {r["file_id"]: (r["license"], r["origin"]) for r in run["license"](made).collect()}
    assert origins[10] == ("MIT", "header") and origins[3][1] in ("none", "inherited")
    kept = {(r["doc_id"], r["text"]) for r in run["deduplicated"](made).collect()}
    assert (None, "no id here") in kept and (4, None) in kept and (9, "repeated id row") in kept and (1, "") in kept and (9, "line a here is long enough\nline b\n") in kept


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, labels, name):
    assert operators(spark, labels)[name](docs(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    parent = {n: n for e in edges for n in e if n is not None}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        if u is not None and v is not None:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {n: root(n) for e in edges for n in e if n is not None and e[0] != e[1] and None not in e}


# op1


def test_license_inheritance(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License.", True), (2, "a/b/c/x.py", "code", False), (3, "a/b/y.py", "Licensed under the Apache License, Version 2.0.\ncode", False), (4, "z.py", "code", False),
        (5, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3.", True), (6, "ab/x.py", None, False), (7, None, "All rights reserved.", None),
    ]
    got = {r["file_id"]: (r["license"], r["origin"], r["from_path"]) for r in license_scan.scan(spark.createDataFrame(files, "file_id long, path string, text string, is_license boolean")).collect()}
    assert got[1] == ("MIT", "header", "a/LICENSE") and got[2] == ("GPL-3.0", "inherited", "a/b/LICENSE") and got[3][:2] == ("Apache-2.0", "header")
    assert got[4] == (None, "none", None) and got[6] == (None, "none", None) and got[7] == (None, "none", None)


def licences(spark, texts):
    files = [(k, f"d{k}/x.txt", t, False) for k, t in enumerate(texts)]
    got = license_scan.scan(spark.createDataFrame(files, "file_id long, path string, text string, is_license boolean")).collect()
    return [r["license"] for r in sorted(got, key=lambda r: r["file_id"])]


def test_prose_is_no_licence(spark):
    assert licences(spark, ["My driving license was under the seat of the car.", "This fishing license is valid to any person.", "Licence fees for television rise in may.", "Released under the Foo License.", "", None, "see license"]) == [None] * 7


def test_statements_and_texts(spark):
    mit = """MIT License

    Copyright (c) 2020 Some One

    Permission is hereby granted, free of charge, to any person obtaining a copy
    of this software and associated documentation files (the "Software"), to deal
    in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
    copies of the Software, and to permit persons to whom the Software is
    furnished to do so, subject to the following conditions:"""
    texts = [mit, "x = 1\n# SPDX-License-Identifier: MIT\n", "SPDX-License-Identifier: ISC", prose(5, 300) + "\nLicensed under CC BY-NC 4.0.\n" + prose(6, 300), "SPDX-License-Identifier: GPL-3.0-or-later", "All rights reserved. " + prose(7, 50)]
    assert licences(spark, texts) == ["MIT", "MIT", "ISC", "CC-BY-NC-4.0", "GPL-3.0", "Proprietary"]


def test_licence_documents(spark):
    text = "Licensed under the Apache License, Version 2.0."
    rows = [(None, "Released under the MIT License."), (1, text), (1, prose(1, 20)), (2, prose(2, 20)), (2, prose(2, 20))]
    made = spark.createDataFrame([(i, t, "en", "s", None, 0, "", 0, 0) for i, t in rows], DOCS)
    got = sorted((str(r["file_id"]), r["origin"], str(r["license"])) for r in license_scan.scan(license_scan.document_files(made)).collect())
    assert ("None", "header", "MIT") in got and ("1", "header", "Apache-2.0") in got and len(got) == 5 and {g[1] for g in got if g[0] == "2"} <= {"inherited", "none"}


# op2


def test_cover_tree_equals_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 8))
    rows = [*base, *(base[0] + 0.02 * r.normal(size=(60, 8))), *(base[1] + 0.15 * r.normal(size=(60, 8))), *[base[2]] * 5, 3 * base[2]]
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] + [0.0] * 6), (904, []), (905, [1.0, 2.0]), (None, [1.0] * 8), (906, [float("inf")] * 8)]
    got = {r["vec_id"]: r for r in cover_tree.near_duplicates(spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")).collect()}
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist() and [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd if i)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cover_tree.near_duplicates(empty).count() == 0


def test_doubles_of_any_size(spark):
    """Components that no float holds, and squares that no double does."""
    rows = [(1, [1e39, 0.0]), (2, [1e39, 1e38]), (3, [1e-46, 0.0]), (4, [0.0, 1e300]), (5, [1e-320, 1e300]), (6, [1e300, 1e300]), (7, [1.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}


def test_many_leaves_and_repeated_ids(spark, monkeypatch):
    """A tree of several levels, clusters, copies beyond a leaf, and two vectors of one id."""
    for name, value in (("PART", 60), ("SAMPLE", 60), ("FAN", 6), ("BLOCK", 128)):
        monkeypatch.setattr(cover_tree, name, value)
    r = np.random.default_rng(17)
    x = np.concatenate([r.normal(size=(60, 6)), *(r.normal(size=6) * 3 + s * r.normal(size=(40, 6)) for s in (0.02, 0.1, 0.3, 0.6)), np.tile(r.normal(size=6), (70, 1)) * (1 + np.arange(70))[:, None]])
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(5, rows[100][1]), (7, rows[70][1]), (None, rows[0][1])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_duplicates(spark.createDataFrame([(*v, 1, "x") for v in rows], "vec_id long, embedding array<float>, cell int, key string")).collect()), key=str)
    ids, u = [i for i, _ in rows[:-1]], np.array([v for _, v in rows[:-1]], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.array(ids)
    for _ in range(len(ids)):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
    want = sorted([(i, int(near[k].sum()), int(label[k]), i == label[k]) for k, i in enumerate(ids)] + [(None, 0, None, True)], key=str)
    assert got == want


def test_leaves_that_all_meet_stay_small_on_disk(spark, monkeypatch):
    """What a stage shuffles, and what stays in the shared folder, are a few times the vectors, not times the leaves."""
    import os
    from urllib.parse import urlparse

    from ionlake.llm.common import shared_folder

    for name, value in (("PART", 40), ("SAMPLE", 60), ("FAN", 8), ("BLOCK", 256), ("SHIP_BYTES", 1)):
        monkeypatch.setattr(cover_tree, name, value, raising=False)
    x = np.random.default_rng(23).normal(size=(1500, 64))
    x[1400:] = x[:100] + 0.1 * x[200:300]
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    folder = urlparse(shared_folder(spark)).path
    before, store = set(os.listdir(folder)), spark.sparkContext._jsc.sc().statusStore()

    def stages():
        every = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {every.apply(k).stageId(): every.apply(k).shuffleWriteBytes() for k in range(every.size())}

    done = stages()
    got = {r["vec_id"]: r["n_links"] for r in cover_tree.near_duplicates(frame).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    assert [got[i] for i in range(len(x))] == ((u @ u.T >= 0.95).sum(1) - 1).tolist() and sum(got.values()) >= 200
    assert max(n for k, n in stages().items() if k not in done) < 6 * 4 * x.size
    (own,) = (d for d in set(os.listdir(folder)) - before if d.startswith("vectors-"))
    assert sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(f"{folder}/{own}") for f in names) < 4 * 4 * x.size


def test_dual_traversal_in_levels():
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(50, 5)), r.normal(size=5) + 0.01 * r.normal(size=(80, 5)), r.normal(size=5) + 0.2 * r.normal(size=(80, 5))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = (cover_tree.Side(v, np.arange(len(v)) + k, np.ones(len(v), dtype=np.int64)) for v, k in ((x[::2], 0), (x[1::2], 500)))
    near = x[::2] @ x[1::2].T >= 0.95
    ca, cb, *_ = cover_tree.joined(a, b, 0.95)
    assert ca.tolist() == near.sum(1).tolist() and cb.tolist() == near.sum(0).tolist()
    own = x[::2] @ x[::2].T >= 0.95
    assert cover_tree.joined(a, a, 0.95)[0].tolist() == (own.sum(1) - 1).tolist()


# op3


def test_media_reads_back(spark):
    got = sorted(media_chunks.media_table(docs(spark)).collect(), key=str)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in ROWS:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])) in [(r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in by[i]]


def test_chunks_are_content_defined():
    data = np.random.default_rng(7).bytes(300_000)
    parts = media_chunks.chunks(data)
    assert b"".join(parts) == data and all(len(p) <= media_chunks.MOST for p in parts) and len(parts) > 10
    moved = media_chunks.chunks(b"xyz" + data)
    assert len(set(parts) & set(moved)) > len(parts) - 5
    h, table = 0, media_chunks._GEAR
    for b in data[:2000]:
        h = (2 * h + int(table[b])) % (1 << 32)
    assert media_chunks.gear_hashes(data[:2000])[-1] == h
    with pytest.raises(ValueError):
        media_chunks.from_media(b"RIFF")


# op4


def test_mix_meets_targets(spark):
    r = random.Random(8)
    rows = [(i, prose(i, r.randint(1, 60)), None, f"s{i % 7}", 0, 0, "", 0, 0) for i in range(700)]
    got = entropy_mix.mix(spark.createDataFrame(rows, DOCS)).toPandas()
    sizes = got.groupby("source").agg(s=("size", "sum"), t=("target", "first"), k=("taken", "sum"), n=("source_size", "first"))
    assert (sizes["s"] == sizes["n"]).all() and abs(sizes["t"].sum() - 1.5 * sizes["s"].sum()) < 1e-6 * sizes["s"].sum() and (sizes["t"] <= 2 * sizes["s"] + 1e-6).all()
    assert (abs(sizes["k"] - sizes["t"]) <= 60).all() and (got["taken"] <= 2 * got["size"]).all()
    weights = dict(zip(sorted(sizes.index), itertools.cycle((5, 2, 1))))
    level = [sizes["t"][s] / w for s, w in weights.items() if sizes["t"][s] < 2 * sizes["s"][s] - 1e-6]
    assert max(level) - min(level) < 1e-6 * max(level)
    again = entropy_mix.mix(spark.createDataFrame(rows[::-1], DOCS)).toPandas()
    assert sorted(map(tuple, again[["doc_id", "taken"]].values)) == sorted(map(tuple, got[["doc_id", "taken"]].values))


def plain_targets(sizes):
    """Targets of sources by name (null last) with so many words: the shares are dealt anew until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, out, open_ones = 1.5 * sum(sizes.values()), {}, list(order)
    while open_ones:
        level = left / sum(weight[s] for s in open_ones)
        full = [s for s in open_ones if level * weight[s] > 2 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_ones}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ones = [s for s in open_ones if s not in full]
    return out


def test_mix_equals_plain_targets(spark):
    """Sources of very different sizes, a null one, ties, repeated rows, null and empty texts."""
    r, rows = random.Random(81), []
    for k, (source, n) in enumerate((("a", 3), ("b", 200), (None, 90), ("", 40), ("é", 70), ("z", 1), ("y", 60))):
        rows += [(1000 * k + i, prose(1000 * k + i, r.randint(1, 50)), None, source, 0, 0, "", 0, 0) for i in range(n)]
    rows += [(5, "same words here", None, "b", 0, 0, "", 0, 0)] * 40 + [(None, None, None, "b", 0, 0, "", 0, 0), (7, "", None, None, 0, 0, "", 0, 0), (None, "no id", None, None, 0, 0, "", 0, 0)]
    sizes = {}
    for row in rows:
        sizes[row[3]] = sizes.get(row[3], 0) + len((row[1] or "").split())
    want, got = plain_targets(sizes), entropy_mix.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and sum(x["target"] for x in {x["source"]: x for x in got}.values()) == pytest.approx(min(1.5, 2) * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]]) and x["taken"] in (0, x["size"], 2 * x["size"])
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 50 for s in sizes)


# op5


def brute_lines(rows):
    seen, kept = [], {}
    for i, t in sorted(rows):
        for k, line in enumerate(t.split("\n"), 1):
            if line.strip():
                seen.append(((i, k), line.strip()))
    first = {}
    for at, line in seen:
        first.setdefault(line, at)
    sets = {line: {line[j : j + 5] for j in range(len(line) - 4)} or {line} for line in first}
    parent = {line: line for line in first}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(first, 2):
        n = len(sets[a] & sets[b])
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            if x != y:
                parent[y if first[x] < first[y] else x] = x if first[x] < first[y] else y
    for at, line in seen:
        if first[root(line)] == at:
            kept.setdefault(at[0], []).append(at[1])
    return kept


def test_lines_equal_brute_force(spark):
    r, pool = random.Random(9), [prose(100 + k, n) for k, n in enumerate((4, 8, 12, 20, 30, 40, 60) * 3)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 5)):
            line = r.choice(pool)
            if r.random() < 0.4:
                at = r.randrange(len(line))
                line = line[:at] + "X" + line[at + 1 :]
            lines.append(r.choice(["", "  "]) + line)
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["kept"] for r in line_dedup.kept_lines(docs(spark, rows)).collect()}
    want = brute_lines(rows)
    assert sum(got.get(i) != want.get(i) for i, _ in rows) <= 1  # banding may miss a pair at the threshold
    texts = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs(spark, rows)).collect()}
    assert all(texts[i] == "\n".join(t.split("\n")[k - 1] for k in got.get(i, [])) for i, t in rows)


def test_lines_of_rows_that_share_an_id(spark):
    line, own = prose(41, 12), prose(42, 12)
    rows = [(1, line), (9, line + "!"), (9, own), (None, own + "?"), (None, prose(43, 9) + "\n" + line), (9, own), (12, None), (13, "")]
    texts = sorted(((r["doc_id"], r["text"]) for r in line_dedup.deduplicated(docs(spark, rows)).collect()), key=str)
    #: The null ids come first, so what they hold stays with them; equal rows share their decisions.
    first = sorted([(None, own + "?"), (None, prose(43, 9) + "\n" + line)], key=lambda r: str(r))
    assert texts == sorted([*first, (1, ""), (9, ""), (9, ""), (9, ""), (12, None), (13, "")], key=str)
    lone = prose(44, 12)
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.deduplicated(docs(spark, [(1, line), (9, line + "!"), (9, lone)])).collect())
    assert got == [(1, line), (9, ""), (9, lone)]
    report = sorted((r["doc_id"], r["n_lines"], r["n_blank"], r["n_kept"], r["dropped"]) for r in line_dedup.line_report(docs(spark, [(1, line + "\n\n" + line), (9, " " + line), (9, lone)])).collect())
    assert report == [(1, 3, 1, 1, [3]), (9, 1, 0, 0, [1]), (9, 1, 0, 1, [])]


def test_buckets_equal_grouping(spark, monkeypatch):
    """Packed entries against a plain grouping, with frequent keys in shares and parts of a few entries."""
    monkeypatch.setattr(line_dedup, "ENTRIES", 200)
    base = prose(71, 20)
    texts = [base + f" {k}" for k in range(150)] + [prose(600 + k // 2, 6) for k in range(60)] + [prose(900 + k, 8) for k in range(40)]
    lines = spark.createDataFrame([(k + (k % 3 << 33), t) for k, t in enumerate(texts)], "num long, line string")
    bands = line_dedup.bands_of(line_dedup.signatures(*line_dedup.shingle_hashes(texts)))
    want = {}
    for k, row in enumerate(bands.tolist()):
        for key in row:
            want.setdefault(key, []).append(k + (k % 3 << 33))
    want = {key: sorted(v) for key, v in want.items() if len(v) > 1}
    for hot in (256, 5):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "HOT_ROW", 64)
        got, members = {}, {}
        for r in line_dedup.bucketed(lines).collect():
            got.setdefault(r["bucket"], []).append(r["id"])
            members.setdefault(r["bucket"], set()).add(r["members"])
        assert {key: sorted(v) for key, v in got.items()} == want
        assert all((members[key] == {len(v)}) if len(v) <= 5 or hot == 256 else min(members[key]) > 1 for key, v in want.items())


def test_bands_find_pairs_at_the_threshold():
    """Of pairs with a similarity of 0.80 to 0.82 no more than the bands' own chance may share no band."""
    r, missed, tried = random.Random(31), 0, 0
    for _ in range(1500):
        a = "".join(r.choice("abcdefghijklmnop") for _ in range(360))
        b = list(a)
        for at in r.sample(range(360), 8):
            b[at] = "#"
        b = "".join(b)
        x, y = ({t[j : j + 5] for j in range(356)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.82:
            tried += 1
            one, two = line_dedup.bands_of(line_dedup.signatures(*line_dedup.shingle_hashes([a, b])))
            missed += (one == two).sum() < line_dedup.AGREEING
    assert tried > 100 and missed <= 1


def test_marks_keep_alike_lines_and_rule_others_out(spark):
    """Fields that differ against a plain count; pairs at the threshold stay, pairs of other prose go, and no join hands them on."""
    from ionlake.llm.buckets import fields_apart, linked_components

    r, texts, near = random.Random(32), [], []
    for k in range(300):
        a = list("".join(r.choice("abcdefghijklmnop") for _ in range(r.choice((40, 360, 2000)))))
        b = list(a)
        for at in r.sample(range(len(a)), len(a) // 45):
            b[at] = "#"
        a, b = "".join(a), "".join(b)
        x, y = ({t[j : j + 5] for j in range(len(t) - 4)} for t in (a, b))
        near.append(len(x & y) / len(x | y) >= 0.8)
        texts += [a, b]
    texts += [prose(2000 + k, 60) for k in range(200)]
    signed = line_dedup.signatures(*line_dedup.shingle_hashes(texts))
    marks = line_dedup.marks_of(signed)
    apart = lambda i, j: int(((signed[i] >> 8 & 3) != (signed[j] >> 8 & 3)).sum())
    pairs = [(i, i + 1) for i in range(0, 600, 2)] + [(i, i + 1) for i in range(600, 799)]
    sides = spark.createDataFrame([(i, *map(int, marks[i]), *map(int, marks[j])) for i, j in pairs], ["i", *[f"{c}_{x}" for x in "ab" for c in line_dedup.MARKS]])
    got = {row["i"]: row["d"] for row in sides.select("i", fields_apart(line_dedup.MARKS).alias("d")).collect()}
    assert got == {i: apart(i, j) for i, j in pairs}
    assert sum(near) > 50 and all(got[2 * k] <= line_dedup.APART for k in range(300) if near[k])
    assert all(got[i] > line_dedup.APART for i in range(600, 799))
    rows = [(1, 600 + k, *map(int, marks[600 + k]), 30) for k in range(30)] + [(2 + k, i, *map(int, marks[i]), 2) for k in range(20) for i in (700 + 2 * k, 701 + 2 * k)]
    seen = []
    confirm = lambda pairs: seen.append(pairs.count()) or pairs
    members = spark.createDataFrame(rows, ["bucket", "id", *line_dedup.MARKS, "members"])
    assert linked_components(members, confirm, Scratch(spark, "t"), 80, carried=tuple(line_dedup.MARKS), alike=fields_apart(line_dedup.MARKS) <= line_dedup.APART) is None and not seen


def test_a_text_is_split_once_not_once_a_line(spark):
    out = line_dedup.deduplicated(docs(spark, [(1, prose(51, 9) + "\n\n" + prose(52, 9)), (2, None)]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(lines#" in plan and "lambdafunction(split(" not in plan


def test_large_buckets_without_links_end(spark):
    """More members than are compared at once, none of them alike; and alike ones that no single centre links."""
    from ionlake.llm.buckets import linked_components

    rows = [(1, i, 10, 40) for i in range(40)] + [(2, i, 10, 20) for i in range(20)]
    members = spark.createDataFrame(rows, "bucket long, id long, n long, members long")
    sketch = lambda ids: ids.select("id", F.array(F.lit(0).cast("long")).alias("sketch"))
    none = linked_components(members, lambda pairs: pairs.where("false"), Scratch(spark, "t"), 80, sketch, 1)
    assert none is None or none.count() == 0
    near = linked_components(members, lambda pairs: pairs.where("v - u = 1"), Scratch(spark, "t"), 80, sketch, 1)
    assert {(r["node"], r["component"]) for r in near.collect()} == {(i, 0) for i in range(40)}


def test_lines_of_all_sizes_are_signed_alike(spark):
    r, rows = random.Random(15), []
    for k in range(20):
        base = prose(700 + k, 40)
        dense = (base[:118] + "q" if k % 2 else base[:120] + "q")[: 119 if k % 2 else 121]
        other = dense + "." if k % 2 else dense[:100] + dense[102:]  # 119 and 120 characters, 121 and 119
        words = "".join(r.choice("abcdefghij") for _ in range(150))
        sparse = "".join(c + (" " if j % 14 == 13 else "") for j, c in enumerate(words))
        for j, line in enumerate((dense, other, sparse, sparse[:70] + " " + sparse[71:] + " a b c")):
            rows.append((100 * k + j, line))
    sets = {i: {t[j : j + 5] for j in range(len(t) - 4)} for i, t in rows}
    assert all(len(sets[i] & sets[i + 1]) > 0.85 * len(sets[i] | sets[i + 1]) for i, _ in rows if i % 2 == 0)
    assert line_dedup.kept_lines(docs(spark, rows)).count() == 40


# op6


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    with open(vocabulary(), encoding="utf-8") as file:
        table = bpe.MergeTable(file.read())
    library = Tokenizer.from_file(vocabulary())
    r = random.Random(10)
    texts = ["".join(r.choice("ab eE  \n\t'sdlr<|endoftext|>01é漢😀 \u0085\x1c.,!ßा") for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += ["a" * 70_000, " " * 66_000 + "x", "'" * 66_000 + "s", "1<|endoftext|>" * 3, "漢字" * 20_000, "".join(r.choice("abcdefgh") for _ in range(80_000))]
    block = bpe.BLOCK
    for k, text in enumerate(texts):
        bpe.BLOCK = (1, 3, 16, block)[k % 4] if len(text) < 100 else block
        ids = [int(i) for part in bpe.encode(text, table) for i in part.split(",")]
        bpe.BLOCK = block
        assert ids == library.encode(text, add_special_tokens=False).ids
        decoder = bpe.StreamDecoder(table)
        assert "".join(decoder.feed(str(i)) for i in ids[:2000]) + decoder.feed("", True) == library.decode(ids[:2000], skip_special_tokens=False)


def test_lookahead_is_sufficient():
    with open(vocabulary(), encoding="utf-8") as file:
        table = bpe.MergeTable(file.read())
    r = random.Random(11)
    for _ in range(200):
        data = "".join(r.choice("abet hing") for _ in range(table.lookahead + 200)).encode()
        cut = table.lookahead + r.randint(1, 100)
        def ends(ids):
            return list(itertools.accumulate(len(table.bytes_of[i]) for i in ids))
        whole, part = table.merge(data), table.merge(data[:cut])
        assert [e for e in ends(whole) if e <= cut - table.lookahead] == [e for e in ends(part) if e <= cut - table.lookahead]


# op7


def test_pages(spark):
    menu = '<nav><a href="/">Home</a></nav><div class="sidebar">Side</div><div class="ad">Buy</div>'
    page = lambda k: f"<html><head><title>T</title><style>p{{}}</style></head><body>{menu}<article><h1>Title {k} &amp; more</h1><p>First <b>bold</b>\n text {k}<br>next<p>Second {k}</article><div class='comments'><p>Nice {k}</p></div><form>f</form><footer>&copy; x</footer><script>var t='</p>';</script></body></html>"
    plain = lambda k: f"<body><div class='x1'><p>Common words of the site</p></div><div class='main'><p>Own words of page {k} that nobody else has</p><p>More words {k * 7}</p></div></body>"
    rows = [(k, "http://a.example.com/x", page(k), "", 0, 0) for k in range(12)] + [(20 + k, "https://b.example.com", plain(k), "", 0, 0) for k in range(12)] + [(90, None, None, None, None, None), (91, "x", "no tags &lt;", "", 0, 0), (92, "http://c/", "<div>" * 3000 + "deep", "", 0, 0)]
    got = {r["page_id"]: r for r in style_tree.main_texts(pages(spark, rows)).collect()}
    assert got[3]["text"] == "Title 3 & more First bold text 3 next Second 3"
    assert got[25]["text"] == "Own words of page 5 that nobody else has More words 35"
    assert got[90]["text"] == "" and got[91]["text"] == "no tags <" and got[92]["text"] == "deep" and got[91]["n_chars"] == 9
    assert style_tree.main_texts(pages(spark, [])).count() == 0


def test_names_of_wrappers_do_not_empty_a_page(spark):
    said = lambda k: f"<p>Own words of page {k} that nobody else has at all</p><p>And more of them {k * 7} to read</p>"
    side = "<div class='sidebar'><p>Links</p></div>"
    pages_of = [lambda k: f"<body class='has-sidebar'>{said(k)}{side}</body>", lambda k: f"<body class='no-sidebar single'>{said(k)}{side}</body>", lambda k: f"<body><div id='page-with-sidebar'>{said(k)}{side}</div></body>"]
    pages_of += [lambda k: f"<body><div class='post share'>{said(k)}</div>{side}</body>", lambda k: f"<body>{'<p>long</p>' * 50}<div class='share'><article>{said(k)}</article>{side}</div></body>"]
    rows = [(100 * n + k, f"http://h{n}/", f(k), "", 0, 0) for n, f in enumerate(pages_of) for k in range(10)]
    got = {r["page_id"]: r["text"] for r in style_tree.main_texts(pages(spark, rows)).collect()}
    assert all(got[100 * n + k] == f"Own words of page {k} that nobody else has at all And more of them {k * 7} to read" for n in range(5) for k in range(10))


def test_pages_of_small_hosts_do_not_depend_on_others(spark, monkeypatch):
    page = lambda k: f"<body><div class='x1'><p>Common words of the site</p></div><div class='y{'' if k else 'z'}'><p>Own words of page {k} that nobody else has</p><p>More words {k * 7}</p></div></body>"
    few = [(k, f"http://h{k // 3}.example/", page(k), "", 0, 0) for k in range(24)]
    other = [(1000 + k, "http://big.example/", f"<body><section><p>Other {k}</p></section></body>", "", 0, 0) for k in range(400)]
    monkeypatch.setattr(style_tree, "WIDESPREAD", 8, raising=False)  # the former share of all pages, at which 400 pages act as 200,000
    got = {r["page_id"]: r["text"] for r in style_tree.main_texts(pages(spark, few + other)).collect()}
    alone = {r["page_id"]: r["text"] for r in style_tree.main_texts(pages(spark, few)).collect()}
    assert got[5] == "Own words of page 5 that nobody else has More words 35" and len(got) == 424
    assert all(got[k] == alone[k] for k in range(24))


def test_trees_decide_what_stays(spark):
    """Adverts, notices and sharing bars go by entropy, within the article too; without the trees they stay."""
    page = lambda k: f"<head><title>T</title><body class='home no-sidebar'><div class='q'>Only today: buy this {k % 2}</div><article><h1>Own title {k}</h1><div class='z'><p>All rights of the site {'very ' * 60} reserved</p></div><p>Own words of page {k} that nobody else has</p></article><div id='b'>Related pages of the site</div>"
    rows = [(k, "http://a.example/", page(k), "", 0, 0) for k in range(30)]
    got = {r["page_id"]: r["text"] for r in style_tree.main_texts(pages(spark, rows)).collect()}
    assert all(got[k] == f"Own title {k} Own words of page {k} that nobody else has" for k in range(30))
    assert all(style_tree.main_text(html, {}) != got[k] for k, _, html, *_ in rows)


def test_articles_are_not_lost(spark):
    rows = [
        (1, "http://a/", "<body class='home no-sidebar'><article><p>hello there</p></article></body>", "", 0, 0), (2, "http://b/", "<head><title>T</title><body><p>hello", "", 0, 0),
        (3, "http://c/", "<article><p>One</p><div class='market-share'><p>Two of them</p></div><section class='related-work'><p>Three</p></section></article><div class='comments'><p>Nice!</p></div>", "", 0, 0),
        (3, "http://c/", "<p>other page, same id</p>", "", 0, 0), (4, "http://d/", "<article>" + "<p>long text</p>" * 20000 + "</article>", "", 0, 0), (5, "", "", "", 0, 0),
    ]
    rows += [rows[0]]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in style_tree.main_texts(pages(spark, rows)).collect())
    long = " ".join(["long text"] * 20000)
    assert got == [(1, "hello there", 11)] * 2 + [(2, "hello", 5), (3, "One Two of them Three", 21), (3, "other page, same id", 19), (4, long, len(long)), (5, "", 0)]


WRAPPERS = {"form": ('<form id="aspnetForm">', "</form>"), "header": ("<header>", "</header>"), "aside": ("<aside>", "</aside>"), "search": ('<div role="search">', "</div>")}


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_marks_around_the_article_do_not_empty_pages(spark, name, tag):
    opened, closed = WRAPPERS[name]
    texts = {k: (prose(k, 4), prose(100 + k, 60)) for k in range(12)}
    html = '<html><body>{}<nav><a href="/">Home</a></nav><{}><h1>{}</h1><p>{}</p></{}><div class="sidebar">Always the same words here</div>{}<footer>Imprint</footer></body></html>'
    rows = [(k, f"http://h.example/{k}", html.format(opened, tag, *t, tag, closed), "x", 0, 0) for k, t in texts.items()]
    assert {r["page_id"]: r["text"] for r in style_tree.main_texts(pages(spark, rows)).collect()} == {k: " ".join(t) for k, t in texts.items()}


def test_pages_of_marked_text_alone_keep_it(spark):
    rows = [(1, "http://one.example/", "<html><body><nav>Home</nav><aside><p>The only words there are</p></aside></body></html>", "x", 0, 0), (2, "http://two.example/", "<body><footer></footer></body>", "x", 0, 0), (3, None, None, "x", 0, 0)]
    got = {r["page_id"]: r["text"] for r in style_tree.main_texts(pages(spark, rows)).collect()}
    assert got == {1: "The only words there are", 2: "", 3: ""}


def test_evidence_can_keep_a_marked_branch(spark, monkeypatch):
    """A menu whose texts never repeat goes on few pages and stays on very many; blocks of a host all get its tree."""
    monkeypatch.setattr(style_tree, "PAGES", 50)
    html = "<html><body><nav>{}</nav><article><p>{}</p></article></body></html>"
    for n, stays in ((12, 0), (500, 500)):
        rows = [(k, "http://h.example/", html.format(prose(5000 + k, 12), prose(100 + k, 40)), "x", 0, 0) for k in range(n)]
        got = {r["page_id"]: r["text"] for r in style_tree.main_texts(pages(spark, rows)).collect()}
        assert sum(prose(5000 + k, 12) in got[k] for k in range(n)) == stays and all(got[k].endswith(prose(100 + k, 40)) for k in range(n))


# op8


def test_documents_equal_brute_force(spark):
    r, rows = random.Random(12), []
    for k in range(25):
        base = prose(500 + k, r.randint(1, 120)).split()
        for _ in range(r.randint(1, 6)):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = prose(r.random(), 1)
            rows.append((len(rows), " ".join(words)))
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)])
    parent = {i: i for i in sets}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in minmax_dedup.similar_documents(docs(spark, rows), words=2).collect()}
    assert all(got[i]["component_id"] == root(i) and got[i]["n_shingles"] == len(sets[i]) for i in sets)


def test_rows_that_share_an_id(spark):
    a, b = prose(31, 60), prose(32, 60)
    rows = [(3, a), (9, a), (9, b), (9, b + " more"), (12, b + " more"), (None, a), (20, ""), (21, None), (21, None)]
    got = sorted((r["doc_id"], r["text"]) for r in minmax_dedup.deduplicated(docs(spark, rows)).collect() if r["doc_id"] is not None)
    least = min((b, b + " more"), key=lambda t: [(r["k1"], r["k2"]) for r in minmax_dedup.keyed(docs(spark, [(9, t)])).collect()])
    assert got[:2] == [(3, a), (9, least)] and got[2:3] == [(20, "")] and len(got) == 5
    by = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minmax_dedup.similar_documents(docs(spark, rows)).collect()}
    assert {(3, 56, 3), (9, 56, 3), (9, 56, 9), (9, 57, 9), (12, 57, 9), (None, 56, None), (20, 0, 20), (21, 0, 21)} == by


# op9


def test_chains_find_passages(spark):
    passage = prose(77, 80).split()
    noisy = [w if k % 17 else "noise" for k, w in enumerate(passage)]
    rows = [(1, prose(21, 60) + " " + " ".join(passage) + " " + prose(22, 60)), (2, prose(23, 30) + " " + " ".join(noisy) + " " + prose(24, 30)), (3, prose(25, 200)), (4, prose(26, 90)), (5, prose(26, 90)), (6, " ".join(passage[:40]))]
    got = {(r["doc_id"], r["of_doc_id"]): r for r in chaining.repeated_passages(docs(spark, rows)).collect()}
    assert set(got) == {(2, 1), (5, 4)}
    one = got[2, 1]
    assert abs(one["start_word"] - 30) <= 1 and abs(one["end_word"] - 110) <= 1 and abs(one["of_start"] - 60) <= 1 and one["identity"] > 0.9


def test_passages_near_each_other_are_both_found(spark):
    one, two, rows = prose(78, 60), prose(79, 60), []
    for k, gap in enumerate((50, 100, 150, 250)):
        for j in (0, 1):
            rows.append((2 * k + j, " ".join([f"x{k}y " * 5 if j else "z " * 5, one.replace(" ", f"{k} "), prose(800 + 2 * k + j, gap), two.replace(" ", f"{k} ")])))
    got = chaining.repeated_passages(docs(spark, rows)).collect()
    for k in range(4):
        mine = sorted((r["start_word"], r["end_word"]) for r in got if r["doc_id"] == 2 * k + 1 and r["of_doc_id"] == 2 * k)
        gap = (50, 100, 150, 250)[k]
        assert len(mine) == 2 and all(abs(x - y) <= 2 for g, w in zip(mine, [(5, 65), (65 + gap, 125 + gap)], strict=True) for x, y in zip(g, w, strict=True))


def test_passage_whose_halves_came_first_is_found(spark):
    for seed in range(2):
        passage = prose(900 + seed, 60).split()
        parts = [passage[:30], passage[30:], passage, passage]
        rows = [(k + 1, " ".join([prose(910 + 10 * seed + k, 40), *part, prose(990 + 10 * seed + k, 40)])) for k, part in enumerate(parts)]
        words = {i: t.split() for i, t in rows}
        runs = {i: {tuple(w[j : j + 51]) for j in range(len(w) - 50)} for i, w in words.items()}
        want = {(i, of) for i, of in itertools.permutations(words, 2) if of < i and runs[i] & runs[of]}
        got = {(r["doc_id"], r["of_doc_id"]): r for r in chaining.repeated_passages(docs(spark, rows)).collect()}
        assert set(got) == want == {(4, 3)}
        assert abs(got[4, 3]["start_word"] - 40) <= 1 and abs(got[4, 3]["end_word"] - 100) <= 1


def brute_passages(rows):
    """Pairs of documents with an equal run of over 50 words."""
    words = {i: t.split() for i, t in rows}
    runs = {i: {tuple(w[j : j + 51]) for j in range(len(w) - 50)} for i, w in words.items()}
    return {(i, of) for i, of in itertools.permutations(words, 2) if of < i and runs[i] & runs[of]}


def test_overlapping_pieces_before_and_after(spark):
    passage = prose(940, 90).split()
    parts = [passage[:50], passage[40:], passage, passage[:50], passage, passage[45:]]
    rows = [(k + 1, " ".join([prose(950 + k, 40), *part, prose(970 + k, 40)])) for k, part in enumerate(parts)]
    got = {(r["doc_id"], r["of_doc_id"]): r["end_word"] - r["start_word"] for r in chaining.repeated_passages(docs(spark, rows)).collect()}
    assert brute_passages(rows) == {(5, 3)} and got.get((5, 3), 0) >= 88


@pytest.mark.parametrize("apart", [False, True])
def test_pieces_all_around_two_whole_passages(spark, apart):
    """Overlapping pieces too short to be passages, before, after and, ``apart``, between the two documents that hold all of it."""
    rows, want = [], set()
    for k in range(10):
        passage, i = prose(9000 + k, 90).split(), 100 * k
        pieces = [passage[a : a + 45] for a in (0, 15, 30, 45)]
        parts = [*pieces, passage, *(pieces[k % 4 :][:1] if apart else []), passage, *pieces]
        whole = [j for j, p in enumerate(parts) if len(p) == 90]
        rows += [(i + j, " ".join([prose(9100 + i + j, 40), *p, prose(12000 + i + j, 40)])) for j, p in enumerate(parts)]
        want.add((i + whole[1], i + whole[0]))
    assert brute_passages(rows) == want
    got = {(r["doc_id"], r["of_doc_id"]): r["end_word"] - r["start_word"] for r in chaining.repeated_passages(docs(spark, rows)).collect()}
    assert set(got) == want and all(n >= 88 for n in got.values())


def test_equal_passages_of_random_overlaps(spark, monkeypatch):
    """Every document that repeats 51 words of an earlier one says so, with an earlier one that holds them."""
    monkeypatch.setattr(chaining, "BLOCKS", 3)
    r, rows = random.Random(44), []
    base = prose(8000, 400).split()
    for i in range(60):
        a = r.randrange(330)
        rows.append((7 * i, " ".join([prose(8100 + i, 30), *base[a : a + r.choice((30, 45, 60, 70))], prose(8200 + i, 30)])))
    want = brute_passages(rows)
    got = {(r["doc_id"], r["of_doc_id"]) for r in chaining.repeated_passages(docs(spark, rows)).collect()}
    assert got <= want and {i for i, _ in got} == {i for i, _ in want}
    linked = {i: i for i, _ in rows}
    for pairs in (want, got):
        root = dict(linked)
        for _ in rows:
            for i, of in pairs:
                root[i] = root[of] = min(root[i], root[of])
        if pairs is want:
            groups = root
    assert root == groups


def test_rows_of_one_id_are_documents(spark):
    passage = prose(941, 70)
    rows = [(1, prose(1, 30) + " " + passage), (1, passage + " " + prose(2, 60)), (2, prose(3, 60) + " " + passage), (2, prose(4, 200)), (2, prose(4, 200)), (None, passage), (7, None), (8, "")]
    got = sorted({(r["doc_id"], r["of_doc_id"]) for r in chaining.repeated_passages(docs(spark, rows)).collect()})
    assert got == [(1, 1), (2, 1)]


def test_recall_on_passages_of_every_eighth_word_changed(spark):
    rows = []
    for k in range(60):
        passage = prose(3000 + k, 100).split()
        rows += [(2 * k, " ".join([prose(4000 + k, 50), *passage, prose(5000 + k, 50)])), (2 * k + 1, " ".join([prose(6000 + k, 50), *(w if j % 8 else f"w{j}q" for j, w in enumerate(passage)), prose(7000 + k, 50)]))]
    got = {(r["doc_id"], r["of_doc_id"]) for r in chaining.repeated_passages(docs(spark, rows)).collect()}
    assert len(got) >= 57 and got <= {(2 * k + 1, 2 * k) for k in range(60)}


def test_a_passage_is_found_whatever_the_hashes_of_its_windows(spark):
    """The 51 words of which fewest windows have a hash below 0.22 of all: a sample of such windows would see one at most."""
    words = prose(31, 60_000).split()
    low = np.append(0, np.cumsum(chaining.run_hashes(chaining.word_hashes([w.encode() for w in words])) < np.uint64(0.22 * 2.0**64)))
    at = int((low[47:] - low[:-47]).argmin())
    assert low[at + 47] - low[at] <= 1
    rows = [(1, " ".join([prose(32, 40), *words[at : at + 51], prose(33, 40)])), (2, " ".join([prose(34, 30), *words[at : at + 51], prose(35, 30)]))]
    got = [(r["doc_id"], r["start_word"], r["end_word"], r["of_doc_id"]) for r in chaining.repeated_passages(docs(spark, rows)).collect()]
    assert len(got) == 1 and got[0][0] == 2 and got[0][3] == 1 and got[0][1] <= 30 and got[0][2] >= 81


def test_a_passage_is_found_behind_its_scattered_pieces(spark):
    passage = prose(36, 80).split()
    pieces = [passage[a : a + 15] for a in range(65, -1, -9)]
    scattered = " ".join(" ".join([*p, prose(40 + k, 20)]) for k, p in enumerate(pieces))
    rows = [(k, " ".join([scattered.replace("x", f"x{k}"), *passage, prose(60 + k, 30)])) for k in (1,)] + [(2, " ".join([prose(70, 30), *passage, prose(71, 30)]))]
    got = {(r["doc_id"], r["of_doc_id"]): r["end_word"] - r["start_word"] for r in chaining.repeated_passages(docs(spark, rows)).collect()}
    assert set(got) == {(2, 1)} and got[2, 1] >= 79


def test_frequent_seeds_are_held_as_all_others(spark):
    from ionlake.llm.common import Scratch

    phrase = prose(72, 12)
    rows = [(i, i % 2, " ".join([prose(80 + i, 60), phrase, prose(95 + i % 5, 30), *([phrase] * (1 + i % 3))])) for i in range(12)]
    rows.append((40, 0, " ".join([prose(73, 8)] * 9)))  # frequent in one document alone
    texts = spark.createDataFrame(rows * 2, "id long, tie int, text string").repartition(3)
    few, many = (sorted(map(tuple, chaining.held_seeds(texts, 1, Scratch(spark, "t"), *more).select("id", "tie", "pos", "first_id", "first_tie").collect())) for more in ((200, 1), ()))
    where = {}
    for i, tie, text in rows:
        w = text.split()
        for p in range(len(w) - 4):
            where.setdefault(tuple(w[p : p + 5]), []).append((i, tie, p))
    want = sorted((*at, *min(places)[:2]) for places in where.values() if len({x[0] for x in places}) > 1 for at in places)
    assert few == many == want


def test_frequent_runs_meet_as_all_others(spark):
    from ionlake.llm.common import Scratch

    sets = [(i, 0, [5, 9, *range(100 + i % 4, 118), *range(1000 * i, 1000 * i + i)]) for i in range(9)]
    marks = spark.createDataFrame([((i, tie), seeds) for i, tie, seeds in sets], f"doc {chaining.KEY}, seeds array<long>").repartition(3)
    few, many = ({(r["doc"]["id"], r["of"]["id"]) for r in chaining.run_pairs(marks, 200, Scratch(spark, "t"), *more).collect()} for more in ((20, 1), ()))
    holders, want = {}, set()
    for i, _, seeds in sets:
        for p in range(len(seeds) - chaining.RUN + 1):
            holders.setdefault(tuple(seeds[p : p + chaining.RUN]), []).append(i)
    for held in holders.values():
        want |= {(i, of) for k, i in enumerate(held) for of in (held[0], held[k - 1]) if of < i}
    assert few == many == want and want


def test_matches_at_many_places():
    a, b = np.array([5, 7, 5, 9]), np.array([5, 9, 5, 5])
    at = np.arange(4)
    assert set(chaining.matches_of(a, at, b, at)) == {(x, y) for x in range(4) for y in range(4) if a[x] == b[y]}
    far = chaining.matches_of(np.zeros(900, int), np.arange(900), np.zeros(700, int), np.arange(700))
    assert len(far) == len(set(far)) < 3 * 900 and {(k, k) for k in range(700)} <= set(far)


def test_banded_edits_equal_full_table():
    r = random.Random(18)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randint(0, 70))] for _ in range(2))
        if r.random() < 0.5:
            b = [x for x in a if r.random() < 0.9]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        far, least = max(len(a), len(b)), row[-1]
        want = (max(0, far - least), far) if a and b else (0, far)
        assert chaining.edits(np.array(a), np.array(b)) == want
        assert chaining.edits(np.array(a), np.array(b), least) == want and (not a or not b or a == b or chaining.edits(np.array(a), np.array(b), least - 1) == (0, far))


def test_long_unequal_gaps_are_aligned():
    r = random.Random(19)
    a = np.array([r.randrange(10**6) for _ in range(3000)])
    b = a.copy()
    b[300:2700:6] = -1
    assert chaining.edits(a, b, 700) == (2600, 3000) and chaining.edits(a, b, 300) == (0, 3000)


def test_alike_runs_equal_quadratic_search():
    r = random.Random(16)
    for _ in range(200):
        steps = [(r.randint(0, c), c) for c in (r.choice((3, 5, 8, 40)) for _ in range(r.randint(0, 14)))]
        steps = [(c, c) if r.random() < 0.6 else (e, c) for e, c in steps]
        ok = [(i, j) for i in range(len(steps) + 1) for j in range(i, len(steps) + 1) if sum(e - 0.8 * c for e, c in steps[i:j]) + 0.2 * chaining.K >= -1e-9]
        got = chaining.alike_runs(steps)
        width = lambda run: sum(c for _, c in steps[run[0] : run[1]])  # noqa: B023, E731
        assert max(map(width, got)) == max(map(width, ok)) and set(got) <= set(ok)
        assert [n for i, j in got for n in range(i, j + 1)] == list(range(len(steps) + 1))


def test_chain_scores_equal_quadratic_search():
    r = random.Random(13)
    for _ in range(50):
        points = sorted({(r.randrange(60), r.randrange(60)) for _ in range(25)})
        best = {}
        for p in points:
            best[p] = 1 + max([0.0, *(best[q] - chaining.GAP * (p[0] - q[0] + p[1] - q[1]) / 2 for q in best if q[0] < p[0] and q[1] < p[1])])
        got = chaining.chains(points)
        if got:
            first = got[0]
            value = len(first) - sum(chaining.GAP * (b[0] - a[0] + b[1] - a[1]) / 2 for a, b in itertools.pairwise(first))
            assert value == pytest.approx(max(best.values()))
        assert len({p for c in got for p in c}) == sum(map(len, got))


def test_edits():
    a = np.arange(10)
    assert chaining.edits(a, a) == (10, 10) and chaining.edits(a, np.delete(a, 4)) == (9, 10) and chaining.edits(a, a[:0]) == (0, 10)


# op10


def test_toxicity_learns(spark):
    r = random.Random(14)
    texts = [" ".join([prose(i, 30), *(["vileness" + r.choice("abc")] if i % 3 == 0 else []), prose(i + 5000, 20)]) for i in range(600)]
    rows = [(i, t, "en", "s", 0, 0, "", 0, 0) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(frame, labels)
    got = toxicity.score(frame, model).toPandas()
    out = got[got["held_out"]]
    assert set(out["doc_id"]) == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert ((out["predicted"] == 1) == (out["doc_id"] % 3 == 0)).mean() > 0.95 and got["score"].between(0, 1).all() and "en" in model.thresholds
    assert toxicity.clean(frame, model).count() == (got["predicted"] == 0).sum()


def test_toxicity_learns_from_all_parts(spark):
    """Each part of the rows has toxic words of its own: whatever rows a sample leaves out, their words would stay unknown."""
    words = ["vile" + a + b for a in "abcdefgh" for b in "xyz"]
    texts = [" ".join([prose(i, 20), *([words[(i // 3) % 24]] * 2 if i % 3 == 0 else []), prose(i + 5000, 10)]) for i in range(900)]
    rows = [(i, t, "en" if i % 2 else "de", "s", 0, 0, "", 0, 0) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    frame, settings = spark.createDataFrame(rows, DOCS), toxicity.Settings(part_rows=150)
    model = toxicity.fit(frame, labels, settings)
    got, again = toxicity.score(frame, model).toPandas(), toxicity.fit(frame.repartition(5), labels.repartition(3), settings)
    out = got[got["held_out"]]
    assert ((out["predicted"] == 1) == (out["doc_id"] % 3 == 0)).mean() > 0.95 and set(model.thresholds) == {"de", "en"}
    assert (again.embed == model.embed).all() and again.out_bias == model.out_bias and again.thresholds == model.thresholds
    changed = lambda m, w: (m.embed[toxicity.features_of(w, settings.buckets)] != toxicity.train([], np.zeros(0), settings).embed.astype(np.float32)[toxicity.features_of(w, settings.buckets)]).any()
    assert all(changed(model, w) for w in words)


def test_best_cut_of_bins_equals_that_of_scores():
    r = np.random.default_rng(5)
    for _ in range(50):
        scores = r.integers(1, 40, 60) / 41
        labels = (r.random(60) < scores).astype(float)
        want = max(2 * labels[scores >= t].sum() / ((scores >= t).sum() + labels.sum()) for t in scores) if labels.any() else None
        at = toxicity.best_threshold(scores, labels, 0.3)
        assert want is None or labels.all() or abs(2 * labels[scores >= at].sum() / ((scores >= at).sum() + labels.sum()) - want) < 1e-12


def test_scores_equal_plain_loops():
    """The streaming scorer against embeddings, filters and pooling in loops."""
    settings = toxicity.Settings(buckets=997, dims=5, filters=3, epochs=1, least_steps=20)
    texts = [prose(k, 30) for k in range(40)]
    model = toxicity.train(texts, np.array([k % 4 == 0 for k in range(40)], float), settings)
    scorer = toxicity.Scorer(model, kept=50)

    def plain(text):
        words = toxicity.words_of(text)
        pad = max(settings.widths) - 1
        vectors = [np.zeros(settings.dims)] * pad + [sum(model.embed[f] for f in toxicity.features_of(w, settings.buckets)) for w in words] + [np.zeros(settings.dims)] * pad
        best = []
        for width, kernel in zip(settings.widths, model.kernels, strict=True):
            for f in range(settings.filters):
                best.append(max(sum(float(vectors[at + j] @ kernel[j, :, f]) for j in range(width)) for at in range(len(vectors) - width + 1)))
        hidden = np.maximum(np.array(best) + model.bias, 0)
        return 1 / (1 + math.exp(-min(30, max(-30, float(hidden @ model.out) + model.out_bias))))

    for text in [*texts[:10], "", " \n", "one", "Ünï CÖDE ünï", " ".join(prose(5, 9) for _ in range(2500))]:
        assert scorer.score(text) == pytest.approx(plain(text), abs=1e-5)


def test_scores_do_not_depend_on_blocks():
    """A block's end within a text is no padding, and texts that share a block keep apart."""
    settings = toxicity.Settings(buckets=997, dims=5, filters=3, epochs=1, least_steps=20)
    model = toxicity.train([prose(k, 30) for k in range(40)], np.array([k % 4 == 0 for k in range(40)], float), settings)
    words = lambda k: prose(900 + k, 2).split()
    texts = [" ".join([words(k)[0]] * 19_999 + words(k)[1:] + [words(k)[0]] * 50) for k in range(12)] + ["", "one", prose(3, 50), ""]
    for text, score in zip(texts, toxicity.Scorer(model).scores(texts), strict=True):
        ids = np.array([[0] * 5] * 2 + [toxicity.features_of(w, settings.buckets) for w in text.split()] + [[0] * 5] * 2)
        vectors = model.embed[ids].sum(axis=1)
        best = [sum(vectors[j : len(vectors) - w + 1 + j] @ k[j] for j in range(w)).max(axis=0) for w, k in zip(settings.widths, model.kernels, strict=True)]
        hidden = np.maximum(np.concatenate(best) + model.bias, 0)
        assert score == pytest.approx(1 / (1 + math.exp(-float(hidden @ model.out) - model.out_bias)), abs=1e-5)
        assert toxicity.Scorer(model).score(text) == score


def test_seeds_go_once_their_chains_are_made(spark, monkeypatch):
    kept = {}
    write, drop = Scratch.write, Scratch.drop

    def written(self, frame):
        out = write(self, frame)
        kept[out[1]] = frame.columns
        return out

    monkeypatch.setattr(Scratch, "write", written)
    monkeypatch.setattr(Scratch, "drop", lambda self, *paths: [kept.pop(p) for p in paths] and drop(self, *paths))  # KeyError: no such table
    passage = prose(61, 80)
    out = chaining.repeated_passages(docs(spark, [(k, prose(70 + k, 30) + " " + passage + " " + prose(80 + k, 30)) for k in range(4)]))
    assert {(r["doc_id"], r["of_doc_id"]) for r in out.collect()} >= {(1, 0), (2, 0), (3, 0)}
    assert kept and not any({"seeds", "run"} & {*columns} or "whole" in columns or columns == ["doc", "of"] for columns in kept.values())


def test_a_text_is_sent_once_for_many_chains(spark):
    """Beside each of its chains a long text fills memory; before shares of them it stands once each."""
    kind = f"doc {chaining.KEY}, of {chaining.KEY}, xs array<int>, ys array<int>"
    rows = [((9, 0), (i, 0), [i, i + 7], [2 * i, 2 * i + 7]) for i in range(300)] + [((8, 0), (1, 0), [0, 1], [150, 151])]
    chains, texts = spark.createDataFrame(rows, kind), {9: prose(1, 700), 8: prose(2, 200), 7: "no chain"}
    known = spark.createDataFrame([((i, 0), t) for i, t in texts.items()], f"doc {chaining.KEY}, text string")
    for share, sent in ((64, 5 + 1), (chaining.SHARE, 2)):
        both = chaining.texts_before(chains, known, "doc", share)
        assert both.where("text is not null").count() == sent and both.where("text is null").count() == len(rows)
        got = both.mapInArrow(chaining._windows("doc", "ys"), f"{kind}, doc_start int, doc_words array<long>").collect()
        assert sorted((r["doc"]["id"], r["of"]["id"], r["xs"]) for r in got) == sorted((d[0], o[0], x) for d, o, x, _ in rows)
        for r in got:
            hashes = chaining.word_hashes(chaining.words_of(texts[r["doc"]["id"]])).view(np.int64).tolist()
            start = max(0, r["ys"][0] - chaining.MARGIN)
            assert r["doc_start"] == start and r["doc_words"] == hashes[start : r["ys"][-1] + chaining.K + chaining.MARGIN]


def test_first_documents_of_many_seeds_are_counted_without_python_numbers():
    """A batch of half a million seeds takes little memory, and the documents are those that a counter finds."""
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    r = np.random.default_rng(4)
    ids, ties = [r.integers(0, 5, 5), r.integers(0, 40, 40), 10**9 + np.append(np.arange(499_000), np.arange(1000)), np.zeros(0, np.int64)], [(np.arange(n) % 2).astype(np.int32) for n in (5, 40, 500_000, 0)]
    keys = [{"id": 3, "tie": k % 2} for k in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, chaining._KEY), pa.array(ids, pa.list_(pa.int64())), pa.array(ties, pa.list_(pa.int32()))], names=["doc", "first_ids", "first_ties"])
    tracemalloc.start()
    next(chaining._pairs(iter([batch.slice(2, 1)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = Counter((d["id"], d["tie"], o["id"], o["tie"]) for d, o in zip(*(c.to_pylist() for c in next(chaining._pairs(iter([batch])))), strict=True))
    want = Counter((k["id"], k["tie"], *of) for k, i, t in zip(keys, ids, ties, strict=True) for of, n in Counter(zip(i.tolist(), t.tolist(), strict=True)).items() if n > 1 and of != (k["id"], k["tie"]))
    assert got == want and peak < 32 << 20


def test_passages_in_turns_shuffle_a_part_at_a_time(spark, monkeypatch):
    """No stage shuffles all windows of all texts or all words of all chains, and the passages are those of one turn."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        every = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {every.apply(k).stageId(): every.apply(k).shuffleWriteBytes() for k in range(every.size())}

    r = random.Random(31)
    words = [prose(k, 1) + str(k) for k in range(3000)]
    texts = [[r.choice(words) for _ in range(600)] for _ in range(120)]
    for k in range(60, 120):  # passages of 70 to 100 words of earlier texts, some with a changed word
        n = r.randint(70, 100)
        texts[k][100 : 100 + n] = texts[k - 60][200 : 200 + n]
        texts[k][120] = r.choice(words)
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    whole = sorted(tuple(x) for x in chaining.repeated_passages(frame).collect())
    done = stages()
    for name, value in (("FEW", 1), ("TURNS", 4), ("SENT", 1), ("ENTRIES", 4096)):
        monkeypatch.setattr(chaining, name, value, raising=False)
    assert sorted(tuple(x) for x in chaining.repeated_passages(frame).collect()) == whole and len(whole) >= 60
    windows = sum(len(t) - chaining.K + 1 for t in texts)
    assert max(n for k, n in stages().items() if k not in done) < 6 * windows
