"""Vector codes: every part of a vector becomes the number of its nearest codebook entry; codebooks come from Lloyd
rounds that skip distances by Elkan's bounds.

The state of a round is a table in the shared folder: for each vector its whole numbers, its codes, for each part an
upper bound of the distance to its entry and for each entry a lower bound. When entries move, the bounds shift by as
much, and a distance is computed only where the triangle inequality leaves open which entry is nearest. Bounds are
whole numbers rounded outwards and comparisons with them strict, so that whatever could tie is decided by the squared
distances themselves, which are integers. A round hands the driver the sums of its entries and nothing else: at most
PARTS * ENTRIES rows.

Of a vector that is null, empty, or holds nulls or values that are not finite, nothing comes out; nor of one with
another length than that of the smallest vec_id. A length that PARTS does not divide is filled up with zeros.
Components beyond LARGEST / SCALE count as that. A null vec_id comes after all others; rows that share an id are
vectors of their own, in the order of their components. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionlake.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 24
#: Bounds count in steps of 1 / FINE; lower ones are kept in two bytes, beyond that as the largest of these.
FINE, MOST = 4, (1 << 16) - 1
ROWS = 512
#: Labels whose sums are sent to all tasks; more of them are joined in as many salted shares.
FEW_LABELS, SALTS = 100_000, 64


def floor_root(squares: np.ndarray) -> np.ndarray:
    """FINE times the root of whole numbers, rounded down, exactly."""
    fine = squares * (FINE * FINE)
    root = np.sqrt(fine.astype(np.float64)).astype(np.int64)
    root -= root * root > fine
    return root + ((root + 1) ** 2 <= fine)


def ceil_root(squares: np.ndarray) -> np.ndarray:
    root = floor_root(squares)
    return root + (root * root < squares * (FINE * FINE))


def distances(numbers: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of every part (n, parts, width) to every entry (parts, entries, width) of its codebook."""
    return ((numbers[:, :, None, :].astype(np.int64) - book[None]) ** 2).sum(axis=-1)


def own_distances(numbers: np.ndarray, codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((numbers - book[np.arange(book.shape[0]), codes]) ** 2).sum(axis=-1)


def assign(numbers: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper and lower bounds of parts that have none yet: argmin takes the lower index of equals."""
    squares = distances(numbers, book)
    codes = squares.argmin(axis=-1)
    return codes, ceil_root(squares.min(axis=-1)), floor_root(squares)


def reassign(numbers: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries moved from ``before`` to ``book``, and how many distances that took.

    An entry is out where the upper bound is below its lower bound, or twice the upper bound below the distance of
    the two entries. Where one is left the own distance is computed, where still one is left that one's.
    """
    n, parts, entries = lower.shape
    moved = ceil_root(((book - before) ** 2).sum(axis=-1))
    apart = floor_root(((book[:, :, None, :] - book[:, None, :, :]) ** 2).sum(axis=-1))
    part = np.arange(parts)
    upper, lower = upper + moved[part, codes], np.maximum(lower - moved[None], 0)
    between = apart[part, codes]
    out = (upper[..., None] < lower) | (2 * upper[..., None] < between)
    np.put_along_axis(out, codes[..., None], True, axis=-1)
    row, at = np.nonzero(~out.all(axis=-1))
    own = codes[row, at]
    square = ((numbers[row, at] - book[at, own]) ** 2).sum(axis=-1)
    upper[row, at], lower[row, at, own] = ceil_root(square), floor_root(square)
    left = ~((upper[row, at][:, None] < lower[row, at]) | (2 * upper[row, at][:, None] < between[row, at]))
    left[np.arange(len(row)), own] = False
    k, entry = np.nonzero(left)
    found = ((numbers[row[k], at[k]] - book[at[k], entry]) ** 2).sum(axis=-1)
    lower[row[k], at[k], entry] = floor_root(found)
    known = np.full((len(row), entries), np.iinfo(np.int64).max)
    known[k, entry] = found
    known[np.arange(len(row)), own] = square
    nearest = known.argmin(axis=-1)
    codes = codes.copy()
    codes[row, at] = nearest
    upper[row, at] = ceil_root(known[np.arange(len(row)), nearest])
    return codes, upper, lower, len(row) + len(k)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _matrix(column: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), *shape)


def _binary(rows: np.ndarray, kind) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype(kind)], pa.binary())


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """(n, length) components as (n, PARTS, width) integers, filled up with zeros."""
    numbers = np.floor(np.clip(values.astype(np.float64), -LARGEST / SCALE, LARGEST / SCALE) * SCALE).astype(np.int32)
    return np.pad(numbers, ((0, 0), (0, -numbers.shape[1] % PARTS))).reshape(len(numbers), PARTS, -1)


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the rows that have a usable vector."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("long")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where("embedding is not null and size(embedding) > 0")
        .where(finite)
    )


def _first_state(book: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            values = piece.column(2).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
            numbers = whole_numbers(values)
            codes, upper, lower = assign(numbers, book)
            yield _state(piece, numbers, codes, upper, lower)

    return run


def _state(piece: pa.RecordBatch, numbers, codes, upper, lower) -> pa.RecordBatch:
    columns = [piece.column(0), piece.column(1), _binary(numbers, np.int32), _binary(codes, np.uint8), _binary(upper, np.int64), _binary(np.minimum(lower, MOST), np.uint16)]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "numbers", "codes", "upper", "lower"])


def _read(piece: pa.RecordBatch, shape: tuple[int, int, int]):
    parts, entries, width = shape
    return (
        _matrix(piece.column(2), np.int32, parts, width),
        _matrix(piece.column(3), np.uint8, parts).astype(np.int64),
        _matrix(piece.column(4), np.int64, parts),
        _matrix(piece.column(5), np.uint16, parts, entries).astype(np.int64),
    )


def _next_state(book: np.ndarray, before: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            numbers, *bounds = _read(piece, book.shape)
            codes, upper, lower, _ = reassign(numbers, *bounds, book, before)
            yield _state(piece, numbers, codes, upper, lower)

    return run


def _coded(book: np.ndarray, before: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            numbers, *bounds = _read(piece, book.shape)
            codes = reassign(numbers, *bounds, book, before)[0]
            errors = own_distances(numbers, codes, book).sum(axis=-1)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)]), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"]
            )

    return run


def _entry_sums(shape: tuple[int, int, int]):
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for piece in _pieces(batches):
            numbers, codes = _matrix(piece.column(0), np.int32, parts, width), _matrix(piece.column(1), np.uint8, parts)
            slots = (np.arange(parts) * entries + codes).ravel()
            counts += np.bincount(slots, minlength=parts * entries)
            np.add.at(sums, slots, numbers.reshape(-1, width))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used.astype(np.int32), counts[used], *sums[used].T)], names=["slot", "uses", *[f"s{i}" for i in range(width)]])

    return run


def moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """Every entry at the floor of its parts' mean, an unused one where it was."""
    sums = [f"s{i}" for i in range(book.shape[2])]
    partial = state.select("numbers", "codes").mapInArrow(_entry_sums(book.shape), ", ".join(["slot int", "uses long", *[f"{s} long" for s in sums]]))
    out = book.reshape(-1, book.shape[2]).copy()
    for row in partial.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("uses", *sums)]).collect():  # at most PARTS * ENTRIES rows
        out[row["slot"]] = [row[s] // row["uses"] for s in sums]
    return out.reshape(book.shape)


def first_book(vectors: DataFrame) -> tuple[np.ndarray, int] | None:
    """The parts of the ENTRIES smallest vec_ids as codebooks, and the vectors' length; None without vectors."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    least = vectors.orderBy(*order).select(F.size("embedding").alias("n")).head()
    if least is None:
        return None
    rows = vectors.where(F.size("embedding") == least["n"]).orderBy(*order).limit(ENTRIES).select("embedding").collect()
    return whole_numbers(np.array([r["embedding"] for r in rows])).transpose(1, 0, 2).astype(np.int64), least["n"]


def digest_of(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds the errors' sum of all rows with the same label, null being one; a sum beyond a long is null."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    shares = sums.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(shares, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("share")))


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label for every sound vector of ``vectors`` (vec_id, embedding, label if there is one)."""
    scratch, usable = Scratch(vectors.sparkSession, "codes"), sound(vectors)
    columns = "vec_id", "code", "error", "label_error", "codebooks_sha256", "label"
    if (start := first_book(usable)) is None:
        none = usable.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"), "label")
        return none.select(*columns)
    book, length = start
    label = T.StructField("label", usable.schema["label"].dataType)
    kept = T.StructType([T.StructField("vec_id", T.LongType()), label, *[T.StructField(c, T.BinaryType()) for c in ("numbers", "codes", "upper", "lower")]])
    state, path = scratch.write(usable.where(F.size("embedding") == length).mapInArrow(_first_state(book), kept))
    before = book
    for turn in range(ROUNDS):
        before, book = book, moved(state, book)
        if turn < ROUNDS - 1:
            after, new = scratch.write(state.mapInArrow(_next_state(book, before), kept))
            scratch.drop(path)
            state, path = after, new
    done = T.StructType([T.StructField("vec_id", T.LongType()), label, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = scratch.settle(state.mapInArrow(_coded(book, before), done))
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(digest_of(book))).select(*columns)
