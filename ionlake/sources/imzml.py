"""imzML as a data source: an XML index of pixels beside a file of binary arrays.

The index is parsed once, on the driver, in a streaming pass; its pixels become partitions of neighbouring byte
ranges, and tasks read only the arrays of their pixels.
"""

from __future__ import annotations

import json
import os
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ionlake.schema import CENTROID, PROFILE, UNKNOWN, FileFormatError, InstrumentMetadata
from ionlake.sources import arrays
from ionlake.sources.lookup import Bounds

SCHEMA = "spectrum_id long, x int, y int, native_id string, mode string, mz array<double>, intensity array<double>"
PARTITION_BYTES = 32 << 20


@dataclass(frozen=True)
class Asset:
    kind: str
    compressed: bool
    offset: int
    elements: int
    size: int


@dataclass(frozen=True)
class Pixel:
    spectrum_id: int
    x: int
    y: int
    native_id: str
    mode: str
    mz: Asset | None
    intensity: Asset | None


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _terms(element) -> dict[str, str]:
    return {e.get("accession"): e.get("value", "") for e in element.iter() if _tag(e) == "cvParam"}


def _mode(terms: dict[str, str]) -> str | None:
    return CENTROID if arrays.CENTROID in terms else PROFILE if arrays.PROFILE in terms else None


def _kind(terms: dict[str, str]) -> str:
    return next((t for a, t in arrays.TYPES.items() if a in terms), "<f8")


def instrument_of(terms: dict[str, str]) -> InstrumentMetadata:
    """The header's accessions as metadata."""
    out = InstrumentMetadata()
    number = lambda a: float(terms[a]) if terms.get(a) not in (None, "") else None
    out.resolution = number("MS:1000011") if "MS:1000011" in terms else number("MS:1001496")
    out.instrument_model = terms.get("MS:1000031") or out.instrument_model
    out.polarity = "positive" if "MS:1000130" in terms else "negative" if "MS:1000129" in terms else out.polarity
    out.calibration_status = next((s for a, s in (("MS:1000592", "external"), ("MS:1000593", "internal"), ("MS:1000747", "instrument")) if a in terms), out.calibration_status)
    out.laser_settings = {n: v for a, n in (("MS:1000867", "wavelength"), ("MS:1000868", "pulse_energy"), ("MS:1000869", "pulse_width")) if (v := number(a)) is not None}
    return out


def read_index(path: str) -> tuple[dict, list[Pixel]]:
    """The header (width, height, count, instrument, uuid) and one entry a spectrum, 1-based, in one pass over the XML.

    A spectrum without exactly one non-empty m/z and one intensity array is an empty placeholder.
    """
    if not os.path.exists(ibd_of(path)):
        raise FileFormatError(f"{ibd_of(path)} is missing")
    groups: dict[str, dict[str, str]] = {}
    header, pixels, header_terms = {"width": 0, "height": 0, "count": None, "uuid": ""}, [], {}
    for event, e in ET.iterparse(path, events=("start", "end")):
        name = _tag(e)
        if event == "start":
            if name == "spectrumList":
                header["count"] = int(e.get("count", 0))
            continue
        if name == "referenceableParamGroup":
            groups[e.get("id")] = _terms(e)
        elif name in ("scanSettings", "fileContent", "instrumentConfiguration", "dataProcessing"):
            terms = _terms(e)
            if name == "scanSettings":
                header["width"], header["height"] = int(terms.get("IMS:1000042") or 0), int(terms.get("IMS:1000043") or 0)
            header["uuid"] = terms.get("IMS:1000080", header["uuid"])
            if name != "fileContent":
                header_terms |= terms
        elif name == "spectrum":
            pixels.append(_pixel(e, groups, len(pixels) + 1))
            e.clear()
    if header["count"] is None:
        raise FileFormatError("no spectrumList")
    header["instrument"] = instrument_of(header_terms)
    return header, pixels


def _pixel(spectrum, groups: dict[str, dict[str, str]], number: int) -> Pixel:
    terms, found = {}, {}
    length = int(spectrum.get("defaultArrayLength") or 0)
    for e in spectrum.iter():
        if _tag(e) == "cvParam":
            terms[e.get("accession")] = e.get("value", "")
        elif _tag(e) == "referenceableParamGroupRef":
            terms |= {a: v for a, v in groups.get(e.get("ref"), {}).items() if a in (arrays.CENTROID, arrays.PROFILE)}
        elif _tag(e) == "binaryDataArray":
            own = _terms(e)
            for ref in e.iter():
                if _tag(ref) == "referenceableParamGroupRef":
                    own = groups.get(ref.get("ref"), {}) | own
            n, offset = int(own.get("IMS:1000103") or length), int(own.get("IMS:1000102") or 0)
            size = int(own.get("IMS:1000104") or e.get("encodedLength") or 0)
            axis = "intensity" if arrays.INTENSITY_AXIS in own else "mz" if arrays.MZ_AXIS in own else None
            if axis and n and offset:
                found.setdefault(axis, []).append(Asset(_kind(own), arrays.ZLIB in own, offset, n, size))
    whole = len(found.get("mz", [])) == len(found.get("intensity", [])) == 1
    return Pixel(number, int(terms.get("IMS:1000050") or 0), int(terms.get("IMS:1000051") or 0), spectrum.get("id", ""), _mode(terms) or UNKNOWN, *((found["mz"][0], found["intensity"][0]) if whole else (None, None)))


def ibd_of(path: str) -> str:
    return os.path.splitext(path)[0] + ".ibd"


class Pixels(InputPartition):
    def __init__(self, path: str, pixels: list[Pixel]) -> None:
        self.path, self.pixels = path, pixels


class ImzmlReader(DataSourceReader):
    """Option ``spectra`` (ids and ranges, '3,7-9') prunes the index before any array is read, and so do pushed filters."""

    def __init__(self, path: str, spectra: str | None = None) -> None:
        self.path = path
        self.ranges = [(int(a), int(b or a)) for a, _, b in (r.partition("-") for r in spectra.split(","))] if spectra else None
        self.bounds = Bounds(("spectrum_id", "x", "y"))

    def partitions(self) -> list[InputPartition]:
        _, pixels = read_index(self.path)
        if self.ranges is not None:
            pixels = [p for p in pixels if any(a <= p.spectrum_id <= b for a, b in self.ranges)]
        if self.bounds:
            pixels = [p for p in pixels if self.bounds.allow(spectrum_id=p.spectrum_id, x=p.x, y=p.y)]
        parts, held, size = [], [], 0
        for p in sorted(pixels, key=lambda p: p.mz.offset if p.mz else 0):
            held.append(p)
            size += sum(a.size or a.elements * 8 for a in (p.mz, p.intensity) if a)
            if size >= PARTITION_BYTES:
                parts.append(Pixels(self.path, held))
                held, size = [], 0
        return [*parts, *([Pixels(self.path, held)] if held or not parts else [])]

    def read(self, partition: Pixels) -> Iterator[pa.RecordBatch]:
        with open(ibd_of(partition.path), "rb") as file:
            length = os.fstat(file.fileno()).st_size

            def load(a: Asset):
                size = a.size if a.compressed else a.elements * int(a.kind[-1])
                if a.offset + size > length:
                    raise FileFormatError("an array lies beyond the end of the file")
                file.seek(a.offset)
                return arrays.decode(file.read(size), a.kind, a.compressed)

            def rows():
                for p in partition.pixels:
                    mz, intensity = (load(p.mz), load(p.intensity)) if p.mz and p.intensity else (arrays.NONE, arrays.NONE)
                    arrays.checked(mz, intensity)
                    yield (p.spectrum_id, p.x, p.y, p.native_id, p.mode), (mz, intensity)

            yield from arrays.batches(rows(), (("spectrum_id", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("native_id", pa.string()), ("mode", pa.string())), ("mz", "intensity"))


class PushedReader(ImzmlReader):
    """The reader that takes Spark's filters; see ``files.lookup`` for the one safe way to it."""

    def pushFilters(self, filters):  # noqa: N802 - the interface's name
        return self.bounds.take(filters)


@dataclass
class Part(WriterCommitMessage):
    file: str
    part: int
    size: int
    rows: list


def encoded(mz, intensity, compressed: bool) -> tuple[bytes, bytes]:
    """A spectrum's two arrays as the .ibd holds them: m/z in doubles, intensities in floats; empty ones take no bytes."""
    return tuple(arrays.encode(v, kind, compressed) if len(v) else b"" for v, kind in ((mz, "<f8"), (intensity, "<f4")))


class ImzmlWriter(DataSourceWriter):
    """Without ``layout`` each task writes a part beside the target and the driver joins the parts.

    With it (``save`` makes one: the first byte and the size of each partition) every task writes straight into the
    target at its own place, and what reaches the driver is the index alone. A task that runs twice writes the same
    bytes to the same place.
    """

    def __init__(self, path: str, overwrite: bool, compressed: bool, layout: str | None = None) -> None:
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        self.path, self.overwrite, self.compressed = path, overwrite, compressed
        self.layout = json.loads(layout) if layout else None

    def write(self, rows: Iterator) -> Part:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        index, at = [], 0
        if self.layout:
            file = self.layout["file"]
            out = open(file, "r+b")  # noqa: SIM115 - closed below
            out.seek(self.layout["starts"].get(str(part), (16, 0))[0])
        else:
            file = f"{ibd_of(self.path)}.{uuid.uuid4().hex}"
            out = open(file, "wb")  # noqa: SIM115
        with out:
            for r in rows:
                entry = [r["spectrum_id"], r["x"], r["y"], r["mode"], len(r["mz"] or [])]
                for data in encoded(r["mz"] or [], r["intensity"] or [], self.compressed):
                    if self.layout and at + len(data) > self.layout["starts"][str(part)][1]:
                        raise ValueError(f"partition {part} is larger than it was when it was measured")
                    entry += [at, len(data)]
                    out.write(data)
                    at += len(data)
                index.append(tuple(entry))
        return Part(file, part, at, index)

    def commit(self, messages: list) -> None:
        if self.layout:
            identity, entries = uuid.UUID(self.layout["identity"]), []
            for m in messages:
                start, size = self.layout["starts"].get(str(m.part), (16, 0))
                if m.size != size:
                    raise ValueError(f"partition {m.part} wrote {m.size} bytes, {size} were measured")
                entries += [(*r[:5], start + r[5], r[6], start + r[7], r[8]) for r in m.rows]
            os.replace(self.layout["file"], ibd_of(self.path))
        else:
            identity, entries = uuid.uuid4(), []
            with open(ibd_of(self.path), "wb") as out:
                out.write(identity.bytes)
                for m in messages:
                    base = out.tell()
                    with open(m.file, "rb") as part:
                        while block := part.read(1 << 20):
                            out.write(block)
                    os.remove(m.file)
                    entries += [(*r[:5], base + r[5], r[6], base + r[7], r[8]) for r in m.rows]
        write_index(self.path, sorted(entries), identity, self.compressed)

    def abort(self, messages: list) -> None:
        for file in {self.layout["file"]} if self.layout else {m.file for m in messages if m}:
            if os.path.exists(file):
                os.remove(file)


def _measured(compressed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for batch in batches:
            for mz, intensity in zip(batch.column(0), batch.column(1), strict=True):
                size += sum(map(len, encoded(*(v.values.to_numpy(zero_copy_only=False) if v.is_valid else arrays.NONE for v in (mz, intensity)), compressed)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([size], pa.int64())], names=["part", "size"])

    return run


def save(spectra: DataFrame, path: str, compressed: bool = False, overwrite: bool = False, parts: int | None = None) -> None:
    """Writes spectra (spectrum_id, x, y, mode, mz, intensity) as imzML, in the order of their numbers, from all tasks at once.

    The first pass measures each partition's bytes; their running sums are where the tasks of the second pass write.
    The partitions are kept on executors' disks between the two, so that both see the same rows. A target that is
    there already is refused before any task starts; a pass that finds other bytes than were measured fails.
    """
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    session = spectra.sparkSession
    session.dataSource.register(ImzmlDataSource)
    rows = spectra.select("spectrum_id", "x", "y", F.lit("").alias("native_id"), "mode", "mz", "intensity")
    ordered = (rows.repartitionByRange(parts, "spectrum_id") if parts else rows.repartitionByRange("spectrum_id")).sortWithinPartitions("spectrum_id").persist(StorageLevel.DISK_ONLY)
    identity, scratch = uuid.uuid4(), f"{ibd_of(path)}.{uuid.uuid4().hex}"
    try:
        at, starts = 16, {}
        for part, size in ordered.select("mz", "intensity").mapInArrow(_measured(compressed), "part int, size long").orderBy("part").collect():  # one row a partition
            starts[part] = (at, size)
            at += size
        with open(scratch, "wb") as out:
            out.write(identity.bytes)
            out.truncate(at)
        layout = json.dumps({"file": scratch, "identity": str(identity), "starts": starts})
        writer = ordered.write.format("imzml").option("compression", "zlib" if compressed else "none").option("layout", layout)
        writer.mode("overwrite" if overwrite else "append").save(path)
    finally:
        ordered.unpersist()
        if os.path.exists(scratch):
            os.remove(scratch)


def write_index(path: str, entries: list[tuple], identity: uuid.UUID, compressed: bool) -> None:
    term = lambda acc, name, value="": f'<cvParam cvRef="{acc.split(":")[0]}" accession="{acc}" name="{name}" value="{value}"/>'
    packing = term(arrays.ZLIB, "zlib compression") if compressed else term("MS:1000576", "no compression")
    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1">\n<cvList count="2"><cv id="MS" fullName="Mass Spectrometry" URI=""/><cv id="IMS" fullName="Imaging MS" URI=""/></cvList>\n')
        out.write(f"<fileDescription><fileContent>{term('IMS:1000080', 'universally unique identifier', f'{{{identity}}}')}{term('IMS:1000031', 'processed')}</fileContent></fileDescription>\n")
        out.write(f'<referenceableParamGroupList count="2"><referenceableParamGroup id="mz">{term(arrays.MZ_AXIS, "m/z array")}{term("MS:1000523", "64-bit float")}{packing}</referenceableParamGroup>')
        out.write(f'<referenceableParamGroup id="intensity">{term(arrays.INTENSITY_AXIS, "intensity array")}{term("MS:1000521", "32-bit float")}{packing}</referenceableParamGroup></referenceableParamGroupList>\n')
        out.write(f'<scanSettingsList count="1"><scanSettings id="s">{term("IMS:1000042", "max count of pixels x", max((e[1] for e in entries), default=0))}{term("IMS:1000043", "max count of pixels y", max((e[2] for e in entries), default=0))}</scanSettings></scanSettingsList>\n')
        out.write(f'<run id="r"><spectrumList count="{len(entries)}">\n')
        for k, (_, x, y, mode, n, a, la, b, lb) in enumerate(entries):
            shown = {CENTROID: term(arrays.CENTROID, "centroid spectrum"), PROFILE: term(arrays.PROFILE, "profile spectrum")}.get(mode, "")
            out.write(f'<spectrum index="{k}" id="Scan={k + 1}" defaultArrayLength="{n}">{shown}<scanList count="1"><scan>{term("IMS:1000050", "position x", x)}{term("IMS:1000051", "position y", y)}</scan></scanList><binaryDataArrayList count="2">')
            for ref, at, size in (("mz", a, la), ("intensity", b, lb)):
                out.write(f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{ref}"/>{term("IMS:1000102", "external offset", at)}{term("IMS:1000103", "external array length", n)}{term("IMS:1000104", "external encoded length", size)}<binary/></binaryDataArray>')
            out.write("</binaryDataArrayList></spectrum>\n")
        out.write("</spectrumList></run></mzML>\n")


class ImzmlDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imzml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ImzmlReader:
        kind = PushedReader if self.options.get("pushdown") == "true" else ImzmlReader
        return kind(self.options["path"], self.options.get("spectra"))

    def writer(self, schema, overwrite: bool) -> ImzmlWriter:
        return ImzmlWriter(self.options["path"], overwrite, self.options.get("compression", "none") == "zlib", self.options.get("layout"))
