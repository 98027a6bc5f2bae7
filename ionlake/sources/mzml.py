"""mzML as a data source: the offset list, or else the places where records begin, makes the partitions; tasks parse their spectra."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ionlake.schema import UNKNOWN, FileFormatError, InstrumentMetadata
from ionlake.sources import arrays
from ionlake.sources.imzml import _kind, _mode, _tag, _terms, instrument_of
from ionlake.sources.lookup import Bounds

SCHEMA = "spectrum_id long, native_id string, mode string, scan_time_ms long, mz array<double>, intensity array<double>"
SPECTRA_A_PARTITION = 256
#: Bytes of a file that its header may take.
HEADER_BYTES = 8 << 20
#: Processing steps by accession, as the headers in question use them.
VENDOR_STEPS = {"MS:1000579": "Baseline Correction", "MS:1000580": "Smoothing", "MS:1000578": "Data Transformation", "MS:1000800": "Deisotoping"}


def index_offset(path: str) -> int:
    """The place of the offset list, named in the file's last 8 KB."""
    with open(path, "rb") as file:
        file.seek(max(0, os.fstat(file.fileno()).st_size - 8192))
        found = re.search(rb"<indexListOffset>(\d+)", file.read())
    if not found:
        raise FileFormatError("the file has no index")
    return int(found[1])


def instrument_metadata(path: str) -> InstrumentMetadata:
    """What the header before the first spectrum says of the instrument and the vendor's processing."""
    head, size = b"", 0
    with open(path, "rb") as file:
        while b"<spectrum " not in head and (more := file.read(1 << 16)) and size < HEADER_BYTES:
            head, size = head + more, size + len(more)
    terms = {m[1].decode(): m[2].decode() for m in re.finditer(rb'accession="([^"]+)"[^>]*?value="([^"]*)"', head.split(b"<spectrum ")[0])}
    terms = {m[1].decode(): "" for m in re.finditer(rb'<cvParam[^>]*accession="([^"]+)"', head.split(b"<spectrum ")[0])} | terms
    found = instrument_of(terms)
    found.vendor_steps = [name for accession, name in VENDOR_STEPS.items() if accession in terms]
    return found


def spectrum_offsets(path: str) -> list[int]:
    with open(path, "rb") as file:
        file.seek(index_offset(path))
        listed = file.read().decode("utf-8", "replace")
    spectra = re.search(r'<index name="spectrum">(.*?)</index>', listed, re.S)
    if not spectra:
        raise FileFormatError("the index lists no spectra")
    return [int(n) for n in re.findall(r"<offset[^>]*>(\d+)</offset>", spectra[1])]


class Range(InputPartition):
    """Spectra whose places the index gives, numbered from ``first``."""

    def __init__(self, path: str, first: int, offsets: list[int]) -> None:
        self.path, self.first, self.offsets = path, first, offsets


class Split(InputPartition):
    """The spectra that begin in a range of bytes, numbered from ``first``."""

    def __init__(self, path: str, first: int, start: int, stop: int) -> None:
        self.path, self.first, self.start, self.stop = path, first, start, stop


OPEN, CLOSE = re.compile(rb"<spectrum[\s>]"), b"</spectrum>"
SPLIT_BYTES, BLOCK = 32 << 20, 1 << 20


def _numbers_of_starts(path: str, size: int) -> list[int]:
    """How many spectra begin in each range of ``size`` bytes: one pass over the bytes, which are not parsed."""
    counts, at, tail = [0] * max(1, -(-os.path.getsize(path) // size)), 0, b""
    with open(path, "rb") as file:
        while block := file.read(BLOCK):
            text = tail + block
            for m in OPEN.finditer(text):
                counts[(at - len(tail) + m.start()) // size] += 1
            at += len(block)
            tail = text[-9:] if not OPEN.match(text[-10:]) else b""
    return counts


def splits(path: str, size: int = SPLIT_BYTES) -> list[Split]:
    """Ranges of bytes that cover a file without an index; records belong to the range in which they begin."""
    out, first = [], 1
    for k, n in enumerate(_numbers_of_starts(path, size)):
        if n:
            out.append(Split(path, first, k * size, (k + 1) * size))
        first += n
    return out


def records_between(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The whole records that begin in [start, stop), in order; the last one is read to its end."""
    with open(path, "rb") as file:
        file.seek(start)
        held, at = b"", start
        while True:
            found = OPEN.search(held)
            if found and at + found.start() >= stop:
                return
            if found and (end := held.find(CLOSE, found.start())) >= 0:
                yield held[found.start() : end + len(CLOSE)]
                held, at = held[end + len(CLOSE) :], at + end + len(CLOSE)
                continue
            if not found and at + len(held) - 9 >= stop:
                return
            if not (more := file.read(BLOCK)):
                if found:
                    raise FileFormatError("a spectrum has no end")
                return
            if not found and len(held) > 9:
                held, at = held[-9:], at + len(held) - 9
            held += more


def _scan_time(spectrum) -> int | None:
    for e in spectrum.iter():
        if _tag(e) == "cvParam" and e.get("accession") == "MS:1000016":
            seconds = "second" in (e.get("unitName") or "") or e.get("unitAccession") == "UO:0000010"
            return round(float(e.get("value")) * (1000 if seconds else 60_000))
        if _tag(e) == "cvParam" and e.get("accession") == "MS:1000015":
            return round(float(e.get("value")) * 1000)
    return None


class MzmlReader(DataSourceReader):
    """Partitions come from the offset list; a file without one is cut where records begin.

    Option ``splitBytes`` sets the size of those cuts.
    """

    def __init__(self, path: str, split_bytes: int = SPLIT_BYTES) -> None:
        self.path, self.split_bytes = path, split_bytes
        self.bounds = Bounds(("spectrum_id",))

    def partitions(self) -> list[InputPartition]:
        try:
            offsets = spectrum_offsets(self.path)
        except FileFormatError:
            return splits(self.path, self.split_bytes) or [Range(self.path, 1, [])]
        if not self.bounds:
            return [Range(self.path, k + 1, offsets[k : k + SPECTRA_A_PARTITION]) for k in range(0, max(1, len(offsets)), SPECTRA_A_PARTITION)]
        wanted = [k for k in range(len(offsets)) if self.bounds.allow(spectrum_id=k + 1)]
        runs, start = [], 0
        for i in range(1, len(wanted) + 1):
            if i == len(wanted) or wanted[i] != wanted[i - 1] + 1 or i - start >= SPECTRA_A_PARTITION:
                runs.append(Range(self.path, wanted[start] + 1, offsets[wanted[start] : wanted[i - 1] + 1]))
                start = i
        return runs or [Range(self.path, 1, [])]

    def read(self, partition: Range | Split) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[bytes]:
            if isinstance(partition, Split):
                yield from records_between(partition.path, partition.start, partition.stop)
                return
            for offset in partition.offsets:
                text = next(records_between(partition.path, offset, offset + 1), None)
                if text is None:
                    raise FileFormatError("the index names a place where no spectrum begins")
                yield text

        def rows():
            for k, text in enumerate(texts()):
                spectrum, number = ET.fromstring(text), partition.first + k
                if not self.bounds.allow(spectrum_id=number):
                    continue
                found = {"mz": arrays.NONE, "intensity": arrays.NONE}
                for a in (e for e in spectrum.iter() if _tag(e) == "binaryDataArray"):
                    terms = _terms(a)
                    inner = next((e.text or "" for e in a if _tag(e) == "binary"), "")
                    found["intensity" if arrays.INTENSITY_AXIS in terms else "mz"] = arrays.from_base64(inner, _kind(terms), arrays.ZLIB in terms) if inner.strip() else arrays.NONE
                if len(found["mz"]):
                    arrays.checked(found["mz"], found["intensity"])
                yield (number, spectrum.get("id"), _mode(_terms(spectrum)) or UNKNOWN, _scan_time(spectrum)), (found["mz"], found["intensity"])

        yield from arrays.batches(rows(), (("spectrum_id", pa.int64()), ("native_id", pa.string()), ("mode", pa.string()), ("scan_time_ms", pa.int64())), ("mz", "intensity"))


class PushedReader(MzmlReader):
    """The reader that takes Spark's filters; see ``files.lookup`` for the one safe way to it."""

    def pushFilters(self, filters):  # noqa: N802 - the interface's name
        return self.bounds.take(filters)


class MzmlDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MzmlReader:
        kind = PushedReader if self.options.get("pushdown") == "true" else MzmlReader
        return kind(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))
