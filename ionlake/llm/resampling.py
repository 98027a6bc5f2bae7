"""Importance resampling towards a target distribution over hashed word runs.

The counts of all documents are a sparse matrix of documents by buckets, written once to the shared folder as blocks
of compressed sparse rows. Its column sums are the corpus's distribution; the same for the target texts gives the
other. A bucket's gain is the whole part of 1000 times the logarithm of their smoothed ratio, a document's weight the
floored mean of its features' gains: the matrix times the vector of gains. Gumbel noise from the document's id turns
weights into scores whose highest are a draw without replacement.

What reaches the driver is one row a bucket, at most BUCKETS; blocks hold the rows of a bounded amount of text, and
no row has more than BUCKETS entries. What a task holds does not grow with the rows that it is given. Null and wordless texts have no features and weight 0. A null doc_id draws its
noise as "null" and comes after all others; rows that share an id have the same noise and follow each other in the
order in which their blocks were written. Empty tables give an empty table; without target texts all gains come from
smoothing alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionlake.llm.common import Scratch, slices, text_of

BUCKETS, SEED = 10_000, 7
LEAST_WORDS, PERCENT = 20, 25
#: Bytes of text whose documents make a block, and bytes of the matrix that Spark's writers and readers hold at once: writers look at
#: their memory every 100 rows, readers decode up to 4,096 rows of a row group, so both need small rows and row groups.
BLOCK, GROUP = 128 << 10, 4 << 20
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
MATRIX = "block long, doc_id array<long>, words array<long>, indptr array<long>, indices array<int>, counts array<int>"


def features_of(text: bytes) -> tuple[int, list[int]]:
    """The number of words, and the checksum of every word and every pair of neighbours."""
    words = text.translate(_BYTES).split()
    single = [crc32(w) for w in words]
    return len(words), single + [crc32(b" " + w, c) for w, c in zip(words[1:], single)]  # noqa: B905 - the last word has no pair


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block: documents in order, of each the buckets that it uses in ascending order and how often."""
    block = TaskContext.get().partitionId() << 32
    for batch in slices(batches, "text", BLOCK):
        ids, words, starts, keys = batch.column(0).cast(pa.int64()), [], [0], []
        for k, text in enumerate(batch.column(1).cast(pa.binary())):
            n, found = features_of(text.as_py())
            words.append(n)
            used, counts = np.unique(np.fromiter(found, np.uint32, len(found)) % BUCKETS, return_counts=True)
            starts.append(starts[k] + len(used))
            keys.append((used.astype(np.int32), counts.astype(np.int32)))
        arrays = [pa.array(x) for x in (np.array(words, np.int64), np.array(starts, np.int64), *[np.concatenate([k[i] for k in keys]) for i in (0, 1)])]
        one = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, *arrays)]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *one], names=["block", "doc_id", "words", "indptr", "indices", "counts"])
        block += 1


def matrix(docs: DataFrame, scratch: Scratch, key: str = "doc_id") -> DataFrame:
    """The written blocks of (``key``, text) rows."""
    return scratch.keep(docs.select(F.col(key).cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_blocks, MATRIX), **{"parquet.block.size": GROUP})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
        indices, counts = (batch.column(i).flatten().to_numpy() for i in (0, 1))
        total += np.bincount(indices, counts, BUCKETS).astype(np.int64)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])


def column_sums(blocks: DataFrame) -> DataFrame:
    """bucket, n for every bucket that is used: each task adds up its blocks first."""
    return blocks.select("indices", "counts").mapInArrow(_sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, spark) -> np.ndarray:
    """The gain of every bucket from the column sums of both sides."""
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    whole = both.crossJoin(both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")))
    ratio = ((F.col("t") + 1).cast("double") * (F.col("all_s") + BUCKETS)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + BUCKETS))
    rows = whole.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()  # BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    for row in rows:
        out[row["bucket"]] = row["gain"]
    return out


def _weighed(gain: np.ndarray):
    """The product of a block and the gains, divided by the row sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, ids, words, indptr, indices, counts = (batch.column(i)[k] for i in range(6))
                starts, used, times = (c.values.to_numpy() for c in (indptr, indices, counts))
                product, features = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (gain[used] * times, times))
                product, features = (x[starts[1:]] - x[starts[:-1]] for x in (product, features))
                n = len(features)
                weight = product // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, words.values, pa.array(features), pa.array(weight), pa.array(np.full(n, block.as_py())), pa.array(np.arange(n, dtype=np.int32))],
                    names=["doc_id", "n_words", "n_features", "weight", "block", "row"],
                )

    return run


def scored(blocks: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, block, row, score of every row of the matrix."""
    weighed = blocks.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long, block long, row int")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank`` to the highest scores, ``percent`` of all rows of ``rows`` rounded down; it is null for the others.

    The rows are sorted in ranges and written; a row's rank is its place in its range and the sizes of those before.
    """
    ordered = rows.orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "block", "row")
    place = F.monotonically_increasing_id()
    kept = scratch.keep(ordered.withColumn("range", F.shiftright(place, 33).cast("int")).withColumn("place", place.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = kept.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.col("start") + F.col("place") + 1
    drawn = F.floor(F.col("total") * percent / F.lit(100)) if percent else F.lit(0)
    return kept.join(F.broadcast(starts), "range").withColumn("rank", F.when(rank <= drawn, rank)).drop("range", "place", "start", "total")  # one row a range


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words for every row of ``docs`` (doc_id, text); ``target`` has a text column."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "resample")
    blocks = matrix(docs, scratch)
    goal = matrix(target.select(F.lit(0).alias("doc_id"), "text"), scratch)
    rows = scored(blocks, gains(column_sums(blocks), column_sums(goal), spark), seed)
    rows = scratch.settle(rows)
    columns = "doc_id", "n_features", "weight", "score", "rank", "n_words"
    drawn = ranked(rows.where(F.col("n_words") >= LEAST_WORDS), scratch, percent)
    return drawn.select(*columns).unionByName(rows.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long")).select(*columns))
