"""Bitmap and PNG files as gray levels between 0 and 1, in numpy: the decoders behind ``sources.images``."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ionlake.schema import FileFormatError

#: Luma weights of red, green and blue.
LUMA = np.array([0.299, 0.587, 0.114])
#: First column and row, and steps, of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def samples(rows: np.ndarray, depth: int, count: int) -> np.ndarray:
    """(rows, count) samples of 1, 2, 4, 8 or 16 bits from rows of bytes, high bits first."""
    if depth == 8:
        return rows[:, :count].astype(np.int64)
    if depth == 16:
        return rows[:, : 2 * count].reshape(len(rows), count, 2).astype(np.int64) @ np.array([256, 1])
    bits = np.unpackbits(rows, axis=1)[:, : count * depth].reshape(len(rows), count, depth).astype(np.int64)
    return bits @ (1 << np.arange(depth - 1, -1, -1))


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """The rows of a PNG pass without their filters; ``step`` is the distance of a byte from its left neighbour's."""
    lines = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.int32)
    for y in range(height):
        how, line = int(lines[y, 0]), lines[y, 1:].astype(np.int32)
        if how == 1:  # each byte is the sum of all so far in its lane
            lanes = np.pad(line, (0, -stride % step)).reshape(-1, step)
            line = (np.cumsum(lanes, axis=0) & 255).ravel()[:stride]
        elif how == 2:
            line = (line + above) & 255
        elif how in (3, 4):
            done, up = [0] * (stride + step), [0] * step + above.tolist()
            for i, v in enumerate(line.tolist()):
                a, b = done[i], up[i + step]
                if how == 3:
                    guess = (a + b) // 2
                else:
                    c = up[i]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[i + step] = (v + guess) & 255
            line = np.array(done[step:], dtype=np.int32)
        elif how:
            raise FileFormatError(f"unknown filter {how}")
        out[y], above = line, line
    return out


def _gray(pixels: np.ndarray, colour: int, depth: int, palette: np.ndarray | None) -> np.ndarray:
    if colour == 3:
        if palette is None:
            raise FileFormatError("a palette is missing")
        return palette[pixels[:, :, 0]] @ LUMA / 255
    shade = pixels[:, :, :3] @ LUMA if colour in (2, 6) else pixels[:, :, 0]
    return shade / ((1 << depth) - 1)


def decode_png(data: bytes) -> np.ndarray:
    """Gray levels [y, x] of a PNG of any depth and colour type, interlaced or not; transparency is ignored."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise FileFormatError("not a PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(chunk)
        at += 12 + size
    if head is None or head[3] not in CHANNELS:
        raise FileFormatError("the header is missing or names no colour type")
    width, height, depth, colour, _, _, laced = head
    raw, n, place = zlib.decompress(b"".join(packed)), CHANNELS[colour], 0
    step, pixels = max(1, n * depth // 8), np.zeros((height, width, n), np.int64)
    for x0, y0, dx, dy in PASSES if laced else ((0, 0, 1, 1),):
        w, h = -(-max(0, width - x0) // dx), -(-max(0, height - y0) // dy)
        if w and h:
            stride = (w * n * depth + 7) // 8
            rows = _unfiltered(raw[place : place + h * (stride + 1)], h, stride, step)
            place += h * (stride + 1)
            pixels[y0::dy, x0::dx] = samples(rows, depth, w * n).reshape(h, w, n)
    return _gray(pixels, colour, depth, palette)


def decode_bmp(data: bytes) -> np.ndarray:
    """Gray levels [y, x] of an uncompressed bitmap of 1, 4, 8, 24 or 32 bits a pixel, rows from the bottom or the top."""
    if data[:2] != b"BM":
        raise FileFormatError("not a bitmap")
    start, header = struct.unpack_from("<II", data, 10)
    width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise FileFormatError(f"{depth} bits a pixel, compression {packing}")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if depth <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        shade = palette[samples(body, depth, width)] @ LUMA / 255
    else:
        n = depth // 8
        shade = body[:, : width * n].reshape(rows, width, n)[:, :, 2::-1] @ LUMA / 255
    return shade[::-1] if height > 0 else shade


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_png(data)


def palette_of(colours: list[tuple[int, int, int]], n: int = 256) -> list[int]:
    """n colours as r << 16 | g << 8 | b, evenly spaced along straight lines between the given ones."""
    at, given = np.linspace(0, len(colours) - 1, n), np.array(colours, float)
    rgb = np.rint(np.stack([np.interp(at, np.arange(len(colours)), given[:, c]) for c in range(3)], axis=1)).astype(int)
    return [r << 16 | g << 8 | b for r, g, b in rgb.tolist()]


#: Eleven evenly spaced colours of the public colour map viridis; between them lines, within 2 levels of it.
VIRIDIS = [(68, 1, 84), (72, 37, 118), (65, 68, 135), (53, 96, 141), (42, 120, 142), (33, 144, 140), (34, 168, 132), (67, 191, 113), (122, 209, 81), (187, 223, 39), (253, 231, 37)]
GRAY = [(0, 0, 0), (255, 255, 255)]
PALETTES = {"viridis": VIRIDIS, "gray": GRAY}
