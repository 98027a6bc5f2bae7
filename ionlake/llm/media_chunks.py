"""Media columns: lossless 8-bit sound files in content-defined chunks, deduplicated and rebuilt by joins."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import Scratch, slices, text_of

UNIT, FILLER = 576, b"\xff"
RATE = 8000
#: A chunk ends where the lowest CUT_BITS bits of the rolling hash are 0, after LEAST bytes and before MOST.
CUT_BITS, LEAST, MOST = 13, 2048, 65536
LEVEL = 9
#: Digests a task remembers having sent, and uses of one chunk that a join key carries before it is salted.
REMEMBERED, USES_A_KEY, HOT_KEYS = 200_000, 1024, 4096
_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], dtype=np.uint32)


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 filled with bytes 255 to a positive multiple of UNIT, and its length without them."""
    data = text.encode()
    return data + FILLER * (-len(data) % UNIT if data else UNIT), len(data)


def to_media(payload: bytes) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples, one per byte."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_media(media: bytes) -> bytes:
    """The samples of such a file; the header must say that they are 8-bit mono PCM."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data":
            if form is None or (form[0], form[1], form[5]) != (1, 1, 8) or at + 8 + size > len(media):
                raise ValueError("not whole 8-bit mono PCM")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def feature_of(payload: bytes) -> str:
    """Mean, root mean square and crossings of the centred samples, and the loudest of 32 equal stretches."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int32) - 128
    square = x.astype(np.int64) ** 2
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    energy = square.reshape(32, -1).sum(axis=1)
    return f"mean={x.mean():.6f};rms={np.sqrt(square.mean()):.6f};crossings={crossings};loudest={int(energy.argmax())}"


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash h = 2 h + gear[byte] mod 2**32 at every byte: a sum over 32 bytes, doubled up in 5 steps."""
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks in order; joined, they are the data."""
    marks = np.flatnonzero((gear_hashes(data) & np.uint32((1 << CUT_BITS) - 1)) == 0) + 1
    out, start = [], 0
    while start < len(data):
        k = int(np.searchsorted(marks, start + LEAST))
        end = min(start + MOST, len(data), int(marks[k]) if k < len(marks) else len(data))
        out.append(data[start:end])
        start = end
    return out


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for text in batch.column(1):
            payload, n_bytes = payload_of(text.as_py())
            media = to_media(payload)
            rows.append((n_bytes, digest_of(media), [digest_of(c) for c in chunks(media)]))
        sizes, media, lists = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media", "chunks"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer, sent = zstandard.ZstdCompressor(level=LEVEL), set()
    for batch in slices(batches, "text"):
        found: dict[bytes, bytes] = {}
        for text in batch.column(0):
            for body in chunks(to_media(payload_of(text.as_py())[0])):
                if (digest := digest_of(body)) not in sent:
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(digest)
                    found[digest] = packer.compress(body)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "body"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (media, seq): joins each file's chunks, checks its digest, reads the payload back."""
    unpacker = zstandard.ZstdDecompressor()
    names = ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(key: bytes, parts: list[bytes]) -> tuple:
        media = b"".join(parts)
        if digest_of(media) != key:
            raise ValueError(f"the chunks of {key.hex()} do not give that file")
        payload = from_media(media)
        return key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)

    key, parts = None, []
    for batch in batches:
        rows = []
        for media, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if media != key:
                if parts:
                    rows.append(read(key, parts))
                key, parts = media, []
            parts.append(unpacker.decompress(body.as_py()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(read(key, parts), types, strict=True)], names=names)


def store(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The ordered chunk lists (doc_id, n_bytes, media, chunks) and the chunk table (digest, salt, body).

    Each distinct chunk is kept once, compressed; the few digests that more than a 4096th of all uses name
    get one row for every 1024 uses or more, told apart by salt. There are at most HOT_KEYS such digests,
    which is what lets them be broadcast.
    """
    texts = docs.select("doc_id", text_of().alias("text"))
    lists = scratch.keep(texts.mapInArrow(_listed, "doc_id long, n_bytes long, media binary, chunks array<binary>"))
    uses = lists.dropDuplicates(["media"]).select(F.explode("chunks").alias("digest")).groupBy("digest").agg(F.count("*").alias("uses"))
    counted = scratch.keep(uses)
    limit = max(USES_A_KEY, (counted.agg(F.sum("uses")).first()[0] or 0) // HOT_KEYS)
    hot = counted.where(F.col("uses") > limit).select("digest", F.ceil(F.col("uses") / F.lit(limit)).cast("int").alias("salts"))
    scratch.hot = scratch.keep(hot)
    raw = texts.select("text").mapInArrow(_bodies, "digest binary, body binary").join(F.broadcast(scratch.hot), "digest", "left")
    salted = raw.select("digest", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "body")
    return lists, salted.dropDuplicates(["digest", "salt"])


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks.

    Every row of ``docs`` gives a row, null ids and repeats too; null texts count as empty. The payload is
    what the rebuilt file holds, after its digest was checked. Equal files are rebuilt once; a file of one
    chunk is read where its chunk lies, the others are gathered first.
    """
    scratch = Scratch(docs.sparkSession, "media")
    lists, bodies = store(docs, scratch)
    wanted = lists.dropDuplicates(["media"]).select("media", F.size("chunks").alias("n_chunks"), F.posexplode("chunks").alias("seq", "digest"))
    wanted = wanted.join(F.broadcast(scratch.hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("media"), F.coalesce("salts", F.lit(1))).cast("int"))
    parts = wanted.select("media", "n_chunks", "seq", "digest", "salt").join(bodies, ["digest", "salt"])
    schema = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    whole = parts.where("n_chunks = 1").select("media", "body").mapInArrow(_rebuilt, schema)
    several = parts.where("n_chunks > 1").select("media", "body", "seq").repartition("media").sortWithinPartitions("media", "seq")
    read = whole.union(several.select("media", "body").mapInArrow(_rebuilt, schema))
    return lists.select("doc_id", "n_bytes", "media", F.size("chunks").alias("n_chunks")).join(read, "media").drop("media")
