"""A content-addressed web archive: payloads once each by strong digest, exact record headers beside them, records by joins.

An archive is two tables in one folder. ``payloads`` holds (digest, size, uses, body), one row for each distinct
payload; ``headers`` holds a row for each record: its exact bytes up to the payload (the WARC header and, where there
is one, the HTTP header), the digest of its payload, and whether the record itself carries the payload or, as a
revisit, only points to it. A record is its head, its payload if it carries it, and two line ends.

Digests are SHA-256. When payloads are stored, all that share a digest are compared by length and two further hashes;
when they are read, the digest is computed from the bytes again. Either stops the job if it fails.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.llm.common import Scratch, shared_folder

#: Payloads from this size on are written once and revisited afterwards.
LEAST = 100
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
#: A digest with more uses than a HOT_KEYS-th of all, and than USES_A_KEY, is joined in shares.
HOT_KEYS, USES_A_KEY = 4096, 1024


def _digest(body: Column) -> Column:
    return F.sha2(body, 256)


def _lines(*lines: Column) -> Column:
    """Header lines and the empty line behind them; null ones are left out."""
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit(END)), "UTF-8")


def _record_id(page: Column, copy: Column, digest: Column, url: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), copy.cast("string"), F.lit(":"), F.substring(F.sha2(F.concat_ws("\n", digest, url), 256), 1, 32), F.lit(">"))


def page_headers(bodies: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, digest, carries, head for every row of ``bodies`` (page_id, url, size, digest).

    Of equal payloads of LEAST bytes and more the record with the smallest (page_id, url) carries the payload, a null
    one after all others; of rows that agree in both one does. Such rows are counted first and then numbered, so no
    group of copies meets in one task.
    """
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    rows = bodies.groupBy("page_id", "url", "size", "digest").agg(F.count("*").alias("n")).withColumn("place", place)
    first = rows.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("place").alias("first"), F.sum("n").alias("uses"))
    several = first.where("uses > 1").select(F.col("digest").alias("of"), "first")
    copies = rows.join(several, F.col("digest") == F.col("of"), "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    carries = F.col("first").isNull() | (F.col("place").eqNullSafe(F.col("first")) & (F.col("copy") == 0))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    uri = F.when(F.col("url").rlike(r"[\x00-\x20\x7F<>]"), F.url_encode("url")).otherwise(F.col("url"))
    named = copies.withColumn("carries", carries).withColumn("http", F.encode(http, "UTF-8"))
    head = _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("carries"), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("copy"), F.col("digest"), F.col("url"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(~F.col("carries"), F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first.page_id"), F.lit(0), F.col("digest"), F.col("first.url")))),
        F.when(~F.col("carries"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length("http") + F.when(F.col("carries"), F.col("size")).otherwise(0)).cast("string")),
    )
    return named.select("page_id", "digest", "carries", F.concat(head, F.col("http")).alias("head"))


def store_payloads(bodies: DataFrame, folder: str) -> None:
    """Writes (digest, size, uses, body) for the distinct payloads of ``bodies`` (size, digest, body).

    Tasks keep one body a digest before anything is shuffled. Payloads that share a digest must agree in length and
    in two other hashes.
    """
    checks = {"size": F.col("size"), "x": F.xxhash64("body"), "c": F.crc32("body")}
    alike = [f for k, v in checks.items() for f in (F.min(v).alias(f"low_{k}"), F.max(v).alias(f"high_{k}"))]
    once = bodies.groupBy("digest").agg(F.first("body").alias("body"), F.count("*").alias("uses"), *alike)
    same = F.lit(True)
    for k in checks:
        same &= F.col(f"low_{k}") == F.col(f"high_{k}")
    checked = F.when(same, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("different payloads have the digest "), F.col("digest"))))
    once.select("digest", F.col("low_size").alias("size"), "uses", checked.alias("body")).write.option("compression", "zstd").parquet(f"{folder}/payloads")


def store_pages(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """Writes a record for every row of ``pages`` (page_id, url, html) into a new archive; null html is empty."""
    bodies = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("body"))
    bodies = bodies.select("page_id", "url", F.octet_length("body").cast("long").alias("size"), _digest(F.col("body")).alias("digest"), "body")
    store_payloads(bodies.select("size", "digest", "body"), folder)
    page_headers(bodies.select("page_id", "url", "size", "digest"), date).write.option("compression", "zstd").parquet(f"{folder}/headers")


def store_records(records: DataFrame, folder: str) -> None:
    """Writes parsed records (path, seq, head, body, as ``parse`` gives them) into a new archive."""
    bodies = records.withColumn("digest", _digest(F.col("body"))).withColumn("size", F.octet_length("body").cast("long"))
    store_payloads(bodies.select("size", "digest", "body"), folder)
    bodies.select("path", "seq", "digest", F.lit(True).alias("carries"), "head", "tail").write.option("compression", "zstd").parquet(f"{folder}/headers")


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``headers`` with the ``payload`` of each and its exact ``record``.

    Payloads are verified before they are joined. The few digests with very many records are spread over shares,
    each with a payload row of its own; there are at most HOT_KEYS of them, which is what lets them be broadcast.
    """
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    limit = max(USES_A_KEY, (payloads.agg(F.sum("uses")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(payloads.where(F.col("uses") > limit).select("digest", F.ceil(F.col("uses") / F.lit(limit)).cast("int").alias("shares")))
    verified = F.when(_digest(F.col("body")) == F.col("digest"), F.col("body")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))))
    held = payloads.select("digest", verified.alias("payload")).join(hot, "digest", "left")
    held = held.select("digest", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"), "payload")
    spread = headers.join(hot, "digest", "left").withColumn("share", F.pmod(F.xxhash64("head"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    end = F.col("tail") if "tail" in headers.columns else F.encode(F.lit(END), "UTF-8")
    whole = F.concat(F.col("head"), F.when(F.col("carries"), F.col("payload")).otherwise(F.lit(b"")), end)
    return spread.join(held, ["digest", "share"]).withColumn("record", whole).drop("share")


def field(head: Column, name: str) -> Column:
    """The value of a WARC header line, null where there is none; only lines before the first empty one count."""
    lines = F.substring_index(F.decode(head, "UTF-8"), END, 1)
    return F.nullif(F.regexp_extract(lines, rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def page_report(spark: SparkSession, folder: str) -> DataFrame:
    """What the archive says of each page: page_id, payload_bytes, payload_digest, record_type, refers_to, record_bytes.

    Types and references are read from the exact headers, sizes and digests are computed from the restored payload.
    A record's own length must agree with its header.
    """
    records = restore(spark, folder)
    page = r"^<urn:page:(-?\d+):"
    number = lambda name: F.nullif(F.regexp_extract(field(F.col("head"), name), page, 1), F.lit("")).cast("long")
    digest = field(F.col("head"), "WARC-Payload-Digest")
    length = F.octet_length("record") - F.instr(F.decode("head", "ISO-8859-1"), END) - 7
    sound = (digest == F.concat(F.lit("sha256:"), F.col("seen"))) & (length == field(F.col("head"), "Content-Length").cast("int"))
    read = records.withColumn("seen", _digest(F.col("payload")))
    return read.select(
        number("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(sound, F.col("seen")).otherwise(F.raise_error(F.lit("a record does not agree with its header"))).alias("payload_digest"),
        field(F.col("head"), "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"),
    )


def archived(pages: DataFrame) -> DataFrame:
    """``page_report`` of an archive of ``pages`` in the shared folder: one row for each row.

    Null ids and urls, repeated rows, empty and null html each have a record of their own; an empty table gives none.
    """
    scratch = Scratch(pages.sparkSession, "archive")
    store_pages(pages, scratch.root)
    return page_report(pages.sparkSession, scratch.root)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}"


_HEAD = re.compile(rb"\r?\n\r?\n")


def _split(path: str, data: bytes) -> Iterator[tuple[str, int, bytes, bytes, bytes]]:
    """The records of one file in order: head up to the payload, payload, and what follows it."""
    stream = io.BytesIO(data)
    raw = gzip.GzipFile(fileobj=stream).read() if data[:2] == b"\x1f\x8b" else data
    at = seq = 0
    while at < len(raw):
        if not (cut := _HEAD.search(raw, at)) or not raw.startswith(b"WARC/", at):
            raise ValueError(f"{path}: no record at byte {at}")
        size = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", raw[at : cut.end()])
        if not size or (end := cut.end() + int(size[1])) > len(raw):
            raise ValueError(f"{path}: the record at byte {at} has no length or is cut off")
        kind = re.search(rb"(?im)^Content-Type:[ \t]*application/http", raw[at : cut.end()])
        inner = _HEAD.search(raw, cut.end(), end) if kind else None
        body = inner.end() if inner else cut.end()
        after = end
        while raw[after : after + 1] in (b"\r", b"\n"):
            after += 1
        yield path, seq, raw[at:body], raw[body:end], raw[end:after]
        at, seq = after, seq + 1


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["path", "seq", "head", "body", "tail"], [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for record in _split(path, data.as_py() or b""):
                rows.append(record)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def parse(files: DataFrame) -> DataFrame:
    """path, seq, head, body, tail of every record of WARC files (path, content as Spark's binaryFile source gives them).

    Plain or gzip, in one stream or a member a record. An empty file has no records; a damaged one stops the job.
    """
    return files.select("path", "content").mapInArrow(_parsed, "path string, seq long, head binary, body binary, tail binary")
