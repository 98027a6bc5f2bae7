"""Fuzzy line deduplication by MinHash.

Equal lines (white space at their ends aside) are one line. Distinct lines get MinHash signatures from their
character shingles; bands of four values (two functions' least and greatest) make buckets; lines that share a bucket and whose marks (bits of all values) differ little are compared by the exact Jaccard
similarity of all their 5-character shingles; the components of those links keep their first line.

Signatures read every 5-character shingle of every line, the same sets that are compared. Lines are split,
deduplicated, bucketed and joined by DataFrame operations; the shingles are hashed in numpy, many lines at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionlake.llm.buckets import fields_apart, linked_components
from ionlake.llm.common import Scratch, slices, text_of
from ionlake.llm.minmax_dedup import _STEP, _linked, _mixed

PERCENT, SHINGLE = 80, 5
#: Each function gives two values of a signature, the least and the greatest under it; bands are of two functions each,
#: and a pair shares AGREEING of them at least.
FUNCTIONS, BANDS, AGREEING = 40, 20, 1
#: Of each value of a signature a mark keeps two bits. Lines whose marks differ in more than APART of these 80 fields are
#: not compared: of pairs at the threshold, whose fields differ with a chance of 0.15 each, one in 100 million.
MARKS, APART = ["mark_0", "mark_1", "mark_2"], 32
#: Entries (a line in a band) that a task packs at once and that a part of them has about; entries of one key beyond which
#: they are known to be a bucket, and how many of those stay together.
ENTRIES, HOT, HOT_ROW = 1 << 20, 256, 1 << 16
_RNG = np.random.default_rng(5)
_ODD = _RNG.integers(0, 1 << 31, FUNCTIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _RNG.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32)
#: White space at the ends of a line, and what fills lines up to one shingle: no text holds it.
BLANK, FILL = " \t\n\x0b\f\r", "\ud800"
#: Shingles that are permuted at once, more if a line has more.
BLOCK = 1 << 15


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the shingle at every place of all lines, and where each line's begin; a shorter line is its own shingle."""
    sizes = np.array([max(SHINGLE, len(x)) for x in lines], dtype=np.int64)
    joined = "".join(x if len(x) >= SHINGLE else x.ljust(SHINGLE, FILL) for x in lines)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    total = np.zeros(max(0, len(codes) - SHINGLE + 1), dtype=np.uint64)
    for j in range(SHINGLE):
        total = total * _STEP + codes[j : len(total) + j]
    whole = np.ones(len(total), dtype=bool)
    ends = np.cumsum(sizes)
    for j in range(1, SHINGLE):
        whole[ends[:-1] - j] = False
    counts = sizes - SHINGLE + 1
    return _mixed(total[whole]), np.cumsum(counts) - counts


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """Each line's distinct hashes, sorted."""
    hashes, starts = shingle_hashes(lines)
    out = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(hashes)], strict=True):
        ordered = np.sort(hashes[a:b])
        fresh = np.empty(b - a, dtype=bool)
        fresh[0] = True
        np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
        out.append(ordered[fresh])
    return out


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(lines, 2 * FUNCTIONS): each line's least and greatest value in each order of the hashes' upper halves."""
    out = np.empty((len(starts), 2 * FUNCTIONS), dtype=np.uint32)
    upper, ends, at = (hashes >> np.uint64(32)).astype(np.uint32), np.append(starts[1:], len(hashes)), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        block, inner = upper[starts[at] : ends[stop - 1]], starts[at:stop] - starts[at]
        for k in range(FUNCTIONS):
            ordered = (block * _ODD[k]) ^ _FLIP[k]
            out[at:stop, k] = np.minimum.reduceat(ordered, inner)
            out[at:stop, FUNCTIONS + k] = np.maximum.reduceat(ordered, inner)
        at = stop
    return out


def bands_of(signed: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signed), BANDS)).copy()
    for r in range(2 * FUNCTIONS // BANDS):
        keys = _mixed(keys * _STEP + signed[:, r * BANDS : (r + 1) * BANDS].astype(np.uint64))
    return keys.view(np.int64)


def marks_of(signed: np.ndarray) -> np.ndarray:
    """(lines, 3): bits 8 and 9 of all values of (lines, 2 * FUNCTIONS), 32 values a word."""
    fields = np.zeros((len(signed), 32 * len(MARKS)), dtype=np.uint64)
    fields[:, : signed.shape[1]] = signed >> np.uint32(8) & np.uint32(3)
    return np.bitwise_or.reduce(fields.reshape(len(signed), len(MARKS), 32) << np.arange(0, 64, 2, dtype=np.uint64), axis=2).view(np.int64)


#: A line's place: its row's id and, as rows of different texts may share one, a hash of the text; and its number.
PLACE = "struct<doc_id: bigint, tie: bigint, line_no: int>"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, line_no from 1, line) of every line that is not blank, without white space at its ends."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("tie"), F.posexplode(F.split(text_of(), "\n")).alias("pos", "raw"))
    return split.select("doc_id", "tie", (F.col("pos") + 1).alias("line_no"), F.btrim("raw", F.lit(BLANK)).alias("line")).where("line <> ''")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(id, line), one row a distinct line, ``id`` its first place.

    Two 64-bit hashes with independent seeds are the key. Repeats meet on the map side first, so a line that
    fills a third of the corpus sends one row a task.
    """
    keyed = lines_of(docs).select(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), F.struct("doc_id", "tie", "line_no").alias("at"), "line")
    return keyed.groupBy("k1", "k2").agg(F.min("at").alias("id"), F.first("line").alias("line")).select("id", "line")


def _cut(keys: np.ndarray, nums: np.ndarray, parts: int, hot: int, share: int) -> Iterator[tuple[int, int, bytes, int, bytes]]:
    """Rows (part, kind, keys, base, rest) of band keys and the numbers of their lines, by part of the keys.

    Kind 0 has the entries. A key that more than ``hot`` of them share is known to be a bucket: its entries go elsewhere
    as rows of kind 1, in shares, and a row of kind 2 tells the key's part how many there were.
    """
    order = np.argsort(keys, kind="stable")
    keys, nums = keys[order], nums[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.diff(np.append(starts, len(keys)))
    often = np.repeat(counts > hot, counts)
    base = int(nums.min())
    pack = lambda part, kind, k, v: (part, kind, k.tobytes(), base, v.astype(np.uint32).tobytes())
    for kind, k, v in ((0, keys[~often], nums[~often] - base), (2, keys[starts[counts > hot]], counts[counts > hot])):
        part = (k.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        part, k, v = part[by], k[by], v[by]
        ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1 if len(part) else []
        for x, y in itertools.pairwise([0, *ends]):
            yield pack(int(part[x]), kind, k[x:y], v[x:y])
    k, v = keys[often], nums[often] - base
    for x in range(0, len(k), share):
        yield pack(-1 - (base + x) % (4 * parts), 1, k[x : x + share], v[x : x + share])


def _packed(parts: int, entries: int, hot: int, share: int):
    """The band keys of lines (num, line), hashed and packed by part: 12 bytes an entry cross the shuffle. Rows of kind 3 have lines' numbers and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        marks: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            out = [r for group in held.values() for r in _cut(*(np.concatenate(c) for c in zip(*group, strict=True)), parts, hot, share)]
            mine, theirs = (np.concatenate(c) for c in zip(*marks, strict=True))
            out.append((-1 - int(mine[0]) % (4 * parts), 3, mine.tobytes(), 0, theirs.tobytes()))
            held.clear()
            marks.clear()
            types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["part", "kind", "keys", "base", "rest"])

        for batch in slices(batches, "line", 1 << 18):
            signed = signatures(*shingle_hashes(batch.column(1).to_pylist()))
            bands, nums = bands_of(signed), batch.column(0).to_numpy()
            marks.append((nums, marks_of(signed)))
            for high in np.unique(nums >> 32).tolist():
                mine = (nums >> 32) == high
                held.setdefault(high, []).append((bands[mine].ravel(), np.repeat(nums[mine], BANDS)))
            size += bands.size
            if size >= entries:
                yield rows()
                size = 0
        if held:
            yield rows()

    return run


def _in_buckets(hot: int):
    """Rows SIGNED from packed rows sorted by part: (bucket, id, members) of entries whose key others share, and lines' marks."""

    def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows[0][0] == 3:
            nums, marks = (np.frombuffer(x, np.int64) for x in (rows[0][1], rows[0][3]))
            none = pa.nulls(len(nums), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(nums), none, *(pa.array(c) for c in marks.reshape(len(nums), -1).T.copy())], names=["bucket", "id", "members", *MARKS])
            return
        keys = np.concatenate([np.frombuffer(k, np.int64) for _, k, _, _ in rows])
        rest = np.concatenate([np.frombuffer(v, np.uint32) for *_, v in rows]).astype(np.int64)
        sizes, kinds = [len(k) // 8 for _, k, _, _ in rows], np.array([kind for kind, *_ in rows])
        nums = rest + np.repeat(np.array([base for *_, base, _ in rows], np.int64), sizes)
        real = np.repeat(kinds != 2, sizes)
        order = np.argsort(keys, kind="stable")
        keys, nums, real, weights = keys[order], nums[order], real[order], np.where(real, 1, rest)[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        members = np.repeat(np.add.reduceat(weights, starts), np.diff(np.append(starts, len(keys))))
        members = np.maximum(members, hot + 1) if (kinds == 1).all() else members
        keep = real & (members > 1)
        for x in range(0, int(keep.sum()), 1 << 18):
            columns = [pa.array(c[keep][x : x + (1 << 18)]) for c in (keys, nums, members)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(columns[0]), pa.int64())] * len(MARKS)], names=["bucket", "id", "members", *MARKS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "keys", "base", "rest")), strict=True):
                if held and (p != part or p < 0):  # shares of frequent keys need not meet
                    yield from found(held)
                    held = []
                part = p
                held.append(tuple(row))
        if held:
            yield from found(held)

    return run


SIGNED = ", ".join(f"{c} long" for c in ("bucket", "id", "members", *MARKS))


def signed_lines(lines: DataFrame) -> DataFrame:
    """Rows SIGNED of two kinds, as both come from one pass: those of ``bucketed``, and the marks of all lines (num, line), without a bucket."""
    parts = max(1, -(-BANDS * lines.count() // ENTRIES))
    packed = lines.select("num", "line").mapInArrow(_packed(parts, ENTRIES, HOT, HOT_ROW), "part long, kind int, keys binary, base long, rest binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(_in_buckets(HOT), SIGNED)


def bucketed(lines: DataFrame) -> DataFrame:
    """(bucket, id, members): the lines (num, line) in each band's bucket that more than one is in.

    A frequent bucket's ``members`` is what one of its shares holds, more than HOT.
    """
    return signed_lines(lines).where("bucket is not null").select("bucket", "id", "members")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs whose shingle sets reach the threshold exactly; of ``texts`` (id, line) only theirs take part in the joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "y", 1 << 18):
            lefts, kept = batch.column(2).to_pylist(), []
            firsts = [x for i, x in enumerate(lefts) if i == 0 or x != lefts[i - 1]]
            left, sets = None, iter(shingle_sets(firsts))
            for i, (x, right) in enumerate(zip(lefts, shingle_sets(batch.column(3).to_pylist()), strict=True)):
                if i == 0 or x != lefts[i - 1]:
                    left = next(sets)
                if _linked(left, right, percent):
                    kept.append(i)
            yield batch.select(["u", "v"]).take(pa.array(kept, pa.int64()))

    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    texts = scratch.keep(texts.join(wanted, "id", "left_semi"))
    one = pairs.join(texts.select(F.col("id").alias("v"), F.col("line").alias("y")), "v")
    both = one.join(texts.select(F.col("id").alias("u"), F.col("line").alias("x")), "u")
    return both.select("u", "v", "x", "y").sortWithinPartitions("u").mapInArrow(run, "u long, v long")


def kept_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, tie, kept): the numbers, in order, of the lines that stay, by id and hash of the text. Texts that keep none have no row."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(distinct_lines(docs).withColumn("num", F.monotonically_increasing_id()))
    scratch.release()
    signed, path = scratch.write(signed_lines(lines))
    scratch.release()
    members = scratch.keep(signed.where("bucket is not null").select("bucket", "id", "members").join(signed.where("bucket is null").select("id", *MARKS), "id"))
    scratch.drop(path)
    scratch.release()
    texts = lines.select(F.col("num").alias("id"), "line")
    found = linked_components(members, lambda pairs: confirmed(pairs, texts, percent, scratch), scratch, percent, carried=tuple(MARKS), alike=fields_apart(MARKS) <= APART)
    stays = lines.select("num", F.col("id").alias("node"))
    if found is not None:
        #: Of each component the first place stays, whatever the numbers of its lines.
        placed = scratch.keep(found.join(lines.select(F.col("num").alias("node"), F.col("id").alias("place")), "node"))
        least = placed.groupBy("component").agg(F.min("place").alias("least"))
        later = placed.join(least, "component").where("place <> least").select(F.col("node").alias("num"))
        stays = stays.join(later, "num", "left_anti")
    return scratch.settle(stays.groupBy(F.col("node.doc_id").alias("doc_id"), F.col("node.tie").alias("tie")).agg(F.sort_array(F.collect_list("node.line_no")).alias("kept")))


def _with_kept(docs: DataFrame, percent: int, *columns: Column) -> DataFrame:
    kept = kept_lines(docs, percent).withColumnsRenamed({"doc_id": "of", "tie": "of_tie"})
    inner = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("tie"), *columns)
    return inner.join(kept, F.col("id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("of_tie")), "left")


def _places(lines: Column, blank: bool) -> Column:
    """The numbers of the lines that are blank, or of those that are not."""
    is_blank = lambda x: F.btrim(x, F.lit(BLANK)) == ""
    return F.filter(F.transform(lines, lambda x, i: F.when(is_blank(x) if blank else ~is_blank(x), i + 1)), lambda x: x.isNotNull())


def line_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, n_blank, n_kept, dropped (line numbers from 1) for every row of ``docs``.

    A line stays if it is the first, by (doc_id, hash of the text, line number), of its component; blank lines
    always stay. A null or empty text is one blank line. Rows of different texts that share a doc_id are told apart
    by their texts; rows that are equal in both share their decisions. A null doc_id comes before all others.
    """
    split = F.split(text_of(), "\n")
    rows = _with_kept(docs, percent, F.size(split).alias("n_lines"), _places(split, False).alias("filled"))
    stays = F.array_intersect("filled", F.coalesce("kept", F.array().cast("array<int>")))
    return rows.select(
        F.col("id").alias("doc_id"), "n_lines", (F.col("n_lines") - F.size("filled")).alias("n_blank"), F.size(stays).alias("n_kept"), F.array_except("filled", stays).alias("dropped")
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all its columns, the text without the lines that do not stay. No row goes; null texts stay null."""
    names = docs.columns
    #: Columns of their own, as an expression within a lambda is evaluated anew for each element: a text would be split once a line.
    rows = _with_kept(docs, percent, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn("lines", F.split("row.text", "\n"))
    rows = rows.withColumn("places", F.sort_array(F.concat(_places(F.col("lines"), True), F.coalesce("kept", F.array().cast("array<int>")))))
    rows = rows.withColumn("stays", F.array_join(F.transform("places", lambda i: F.get("lines", i - 1)), "\n"))
    out = []
    for c in names:
        if c == "text":
            out.append(F.col("stays").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("row.text").isNotNull(), F.length("stays")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("row").getField(c).alias(c))
    return rows.select(*out)
