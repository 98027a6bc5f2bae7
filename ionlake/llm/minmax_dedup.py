"""Near-duplicate documents by min-max hashing.

Each hash evaluation of a shingle set yields two signature values, its least and its greatest, so 40 functions
give 80 values. Bands of four (two functions' least and greatest) put documents into buckets. A bucket is
never expanded into pairs: its members are compared with one centre, another in every band and round, and
linked if the full sets agree. What the rounds leave in different components of one bucket is compared in full.
Parity sketches, which bound from below in how many shingles two sets differ, spare most of the other pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionlake.llm.buckets import linked_components, shared_buckets
from ionlake.llm.common import WORD, Scratch, slices, text_of

FUNCTIONS, BANDS = 40, 20
#: 64-bit words of a parity sketch.
SKETCH = 16
_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_KNOWN: dict[bytes, int] = {}  # word hashes of a Python worker, emptied when full
KNOWN_WORDS = 600_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


def shingles(text: str, words: int) -> np.ndarray:
    """Distinct hashes, sorted, of the runs of so many words; a shorter text is one run. Only A-Z are lower-cased."""
    split = text.encode().lower().split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    found = list(map(_KNOWN.get, split))
    if None in found:
        if len(_KNOWN) > KNOWN_WORDS:
            _KNOWN.clear()
        for w in split:
            if w not in _KNOWN:
                _KNOWN[w] = xxhash.xxh3_64_intdigest(w)
        found = list(map(_KNOWN.__getitem__, split))
    hashes, size = np.array(found, dtype=np.uint64), min(words, len(split))
    total = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        total = _mixed(total * _STEP + hashes[j : len(hashes) - size + 1 + j])
    return np.unique(total)


def signature(of: np.ndarray) -> np.ndarray:
    """(FUNCTIONS, 2): the least and greatest value under each function."""
    out = np.empty((FUNCTIONS, 2), dtype=np.uint64)
    out[:, 0], out[:, 1] = np.iinfo(np.uint64).max, 0
    for start in range(0, len(of), 4096):
        values = (of[None, start : start + 4096] ^ _FLIP[:, None]) * _ODD[:, None]
        out[:, 0] = np.minimum(out[:, 0], values.min(axis=1))
        out[:, 1] = np.maximum(out[:, 1], values.max(axis=1))
    return out


def parity(of: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """The parity sketch: of each of 64 * words classes of hashes, whether the set holds an odd number."""
    odd = np.bincount((of % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys from (documents, FUNCTIONS, 2)."""
    grouped = signatures.reshape(len(signatures), BANDS, -1)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for k in range(grouped.shape[2]):
        keys = _mixed(keys * _STEP + grouped[:, :, k])
    return keys.view(np.int64)


def _linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(left, right, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(left) + len(right) - common)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, k1, k2 (of the text), n_shingles, set_key (a digest of the whole set), the keys of its bands and its parity sketch."""

    def lists(rows: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(rows).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, keys, odd, signatures = [], [], np.empty((batch.num_rows, SKETCH), dtype=np.int64), np.empty((batch.num_rows, FUNCTIONS, 2), dtype=np.uint64)
            for i, text in enumerate(batch.column("text")):
                found = shingles(text.as_py(), words)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                signatures[i], odd[i] = signature(found), parity(found)
            columns = [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists(bands_of(signatures)), lists(odd)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n_shingles", "set_key", "bands", "sketch"])

    return keyed(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, k1, k2 and text: together the first three tell rows of different texts apart that share an id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("k1"), F.xxhash64(F.lit(1), text_of()).alias("k2"), text_of().alias("text"), *more)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold; ``texts`` has (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in slices(batches, "right"):
            kept = []
            for i, (u, text, other) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if u != last:
                    last, left = u, shingles(text.as_py(), words)
                if _linked(left, shingles(other.as_py(), words), percent):
                    kept.append(i)
            yield batch.select(["u", "v"]).take(pa.array(kept, pa.int64()))

    one = pairs.join(texts.select(F.col("rep").alias("v"), F.col("text").alias("right")), "v")
    both = one.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("left")), "u")
    kind = "struct<rep: bigint, tie: bigint>"
    return both.select("u", "v", "left", "right").sortWithinPartitions("u").mapInArrow(run, f"u {kind}, v {kind}")


def classes(docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component (rep: its smallest doc_id, tie) for every row of ``docs``; no component where nothing can link."""
    sketched = scratch.keep(sketches(docs, words))
    real = sketched.where("doc_id is not null and n_shingles > 0")
    #: A set is a number and a tie, as rows of different texts may share an id.
    rep = F.struct(F.col("f.doc_id").alias("rep"), F.xxhash64("set_key").alias("tie")).alias("rep")
    sets = real.groupBy("set_key").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("f"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    sets = scratch.keep(sets.select("set_key", rep, "f", "n", "bands", "sketch"))
    members = scratch.keep(shared_buckets(sets.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"), "n")))
    wanted = sets.select("rep", "f.*").join(members.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi")
    texts = scratch.keep(keyed(docs).join(wanted, ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"]).select("rep", "text"))
    sketch_of = sets.select(F.col("rep").alias("id"), "sketch")
    found = linked_components(members, lambda pairs: confirmed(pairs, texts, words, percent), scratch, percent, lambda ids: sketch_of.join(ids, "id"), SKETCH)
    of = sets.select("set_key", "rep", F.col("rep").alias("component"))
    if found is not None:
        of = of.drop("component").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    joined = sketched.select("doc_id", "k1", "k2", "n_shingles", "set_key").join(of.select("set_key", "component"), "set_key", "left")
    return joined.select("doc_id", "k1", "k2", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).alias("component"))


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked if their sets of ``words``-word shingles have a Jaccard similarity of at least
    ``percent`` in a hundred; component_id is the smallest doc_id reachable. Texts without words link with
    nothing. Equal sets are one representative, so copies never meet in pairs. Rows that share a doc_id are
    classed by their own texts; a null doc_id is compared with nothing and kept. A bucket is missed by all 20 bands with a
    chance of 2 in 100,000 at a similarity of 0.8. Other columns than doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "minmax")
    found = scratch.settle(classes(docs, words, percent, scratch)).withColumn("component_id", F.coalesce("component.rep", "doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all its columns, one row of each group of near duplicates: that of the smallest doc_id.

    Rows are told apart by id and text, so a row of an id goes or stays by its own text; of equal rows one stays.
    Rows without words and rows with a null id all stay.
    """
    scratch, names = Scratch(docs.sparkSession, "minmax"), docs.columns
    found = classes(docs, words, percent, scratch).where("component is not null")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("f"))
    stays = scratch.settle(first.select(F.col("f.doc_id").alias("id"), F.col("f.k1").alias("x1"), F.col("f.k2").alias("x2")))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    whole = keyed(docs, row).drop("text").withColumn("real", F.col("doc_id").isNotNull() & F.col("row.text").rlike(WORD))
    same = (F.col("doc_id") == F.col("id")) & (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2"))
    kept = whole.where(F.coalesce("real", F.lit(False))).join(stays, same, "left_semi").groupBy("doc_id", "k1", "k2").agg(F.first("row").alias("row"))
    return kept.select("row.*").union(whole.where(~F.coalesce("real", F.lit(False))).select("row.*"))
