"""Binary arrays of the imaging formats: element types, compression, byte order; checks of what was read."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ionlake.schema import FileFormatError, InvalidSpectrumError

#: Element types by accession of the public controlled vocabulary.
TYPES = {"MS:1000518": "<i2", "MS:1000519": "<i4", "MS:1000520": "<f8", "MS:1000521": "<f4", "MS:1000522": "<i8", "MS:1000523": "<f8", "IMS:1000141": "<i4", "IMS:1000142": "<i8"}
ZLIB, MZ_AXIS, INTENSITY_AXIS = "MS:1000574", "MS:1000514", "MS:1000515"
CENTROID, PROFILE = "MS:1000127", "MS:1000128"
NONE = np.zeros(0)
#: Spectra and array elements after which a batch of rows goes to Spark.
ROWS, ELEMENTS = 1024, 1 << 20


def decode(raw: bytes, kind: str, compressed: bool) -> np.ndarray:
    data = zlib.decompress(raw) if compressed else raw
    if len(data) % np.dtype(kind).itemsize:
        raise FileFormatError("an array's bytes are no whole number of elements")
    return np.frombuffer(data, dtype=kind).astype(float)


def encode(values, kind: str, compressed: bool) -> bytes:
    raw = np.asarray(values).astype(kind).tobytes()
    return zlib.compress(raw) if compressed else raw


def from_base64(text: str, kind: str, compressed: bool) -> np.ndarray:
    return decode(base64.b64decode(text), kind, compressed)


def checked(mz: np.ndarray, intensity: np.ndarray) -> None:
    """Equal length, finite, m/z not decreasing; negative intensities and empty spectra pass."""
    if len(mz) != len(intensity) or not np.isfinite(mz).all() or not np.isfinite(intensity).all() or (np.diff(mz) < 0).any():
        raise InvalidSpectrumError("arrays differ in length, hold non-finite numbers or an axis out of order")


def batches(rows: Iterator[tuple], plain: tuple[tuple[str, pa.DataType], ...], listed: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Arrow batches from (values of the plain columns, arrays of the listed ones): no element becomes a Python object."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        values, lists = zip(*held, strict=True)
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*values, strict=True), plain, strict=True)]
        for axis in zip(*lists, strict=True):
            ends = np.concatenate([[0], np.cumsum([len(a) for a in axis])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(axis))))
        return pa.RecordBatch.from_arrays(columns, names=[*[n for n, _ in plain], *listed])

    for row in rows:
        held.append(row)
        size += sum(len(a) for a in row[1])
        if len(held) >= ROWS or size >= ELEMENTS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
