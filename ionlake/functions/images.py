"""Raster functions on numpy images: thresholds, morphology, resizing, region masks."""

from __future__ import annotations

from collections import deque

import numpy as np


def otsu(image: np.ndarray, bins: int = 256) -> float:
    """The threshold that separates two classes best; the image's value where all pixels agree."""
    low, high = float(image.min()), float(image.max())
    if low == high:
        return low
    counts, edges = np.histogram(image, bins=bins, range=(low, high))
    middle = (edges[:-1] + edges[1:]) / 2
    below = np.cumsum(counts)
    above = below[-1] - below
    mass = np.cumsum(counts * middle)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return float(middle[int(np.nanargmax(np.where((below > 0) & (above > 0), spread, -1)))])


def binarize(image: np.ndarray, scale: float = 1.0) -> np.ndarray:
    return image >= otsu(image) * scale


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected regions numbered from 1, 0 outside."""
    out, last = np.zeros(mask.shape, dtype=np.int64), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if not out[start]:
            last += 1
            out[flood(mask, start) & (out == 0)] = last
    return out


def flood(mask: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    """The 4-connected region of the seed's value."""
    out, want, queue = np.zeros(mask.shape, dtype=bool), mask[seed], deque([seed])
    out[seed] = True
    while queue:
        y, x = queue.popleft()
        for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and not out[a, b] and mask[a, b] == want:
                out[a, b] = True
                queue.append((a, b))
    return out


def area_open(mask: np.ndarray, least: int) -> np.ndarray:
    """Regions of fewer pixels go."""
    regions = label(mask)
    sizes = np.bincount(regions.ravel())
    keep = sizes >= least
    keep[0] = False
    return keep[regions]


def area_close(mask: np.ndarray, least: int) -> np.ndarray:
    """Holes of fewer pixels are filled."""
    return ~area_open(~mask, least)


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    back, on = (size - 1) // 2, size // 2
    padded = np.pad(mask, ((back, on), (back, on)))
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size)).any(axis=(2, 3))


def close(mask: np.ndarray, size: int) -> np.ndarray:
    """Dilation, then erosion, by a square of ones."""
    wide = np.pad(mask, size)
    grown = dilate(wide, size)
    return ~dilate(~grown[::-1, ::-1], size)[::-1, ::-1][size:-size, size:-size]


def region_of_interest(image: np.ndarray, scale: float = 1.0, noise: float = 0.1, hole: float = 0.05, size: int = 2) -> dict[str, np.ndarray]:
    """The steps of a mask: threshold, without specks, without holes, smoothed."""
    first = binarize(image, scale)
    opened = area_open(first, round(image.size * noise))
    closed = area_close(opened, round(image.size * hole))
    return {"binary": first, "opened": opened, "closed": closed, "smoothed": close(closed, size)}


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    at = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
    y, x = at(height, image.shape[0]), at(width, image.shape[1])
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    im = image.astype(float)
    return (1 - fy) * ((1 - fx) * im[y0][:, x0] + fx * im[y0][:, x1]) + fy * ((1 - fx) * im[y1][:, x0] + fx * im[y1][:, x1])


def mask_from(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return resize(binarize(image), height, width) > 0.5


def mask_pixels(mask: np.ndarray) -> list[tuple[int, int]]:
    """(x, y) from 1 of the true pixels."""
    return [(int(x) + 1, int(y) + 1) for y, x in zip(*np.nonzero(mask), strict=True)]


def turn(mask: np.ndarray, quarters: int) -> np.ndarray:
    """Rotated, its centre on the old frame's, cut or filled with zeros there."""
    turned, out = np.rot90(mask, quarters), np.zeros_like(mask)
    size = [min(a, b) for a, b in zip(turned.shape, out.shape, strict=True)]
    a, b = ([(s - k) // 2 for s, k in zip(i.shape, size, strict=True)] for i in (turned, out))
    out[b[0] : b[0] + size[0], b[1] : b[1] + size[1]] = turned[a[0] : a[0] + size[0], a[1] : a[1] + size[1]]
    return out


def shift(mask: np.ndarray, dx: int, dy: int) -> np.ndarray:
    out = np.zeros_like(mask)
    h, w = mask.shape
    if abs(dx) < w and abs(dy) < h:
        out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def disc(mask: np.ndarray, x: int, y: int, size: float, value: bool = True) -> np.ndarray:
    """The brush: pixels within half the size of (x, y), counted from 1, get the value."""
    ys, xs = np.ogrid[1 : mask.shape[0] + 1, 1 : mask.shape[1] + 1]
    out = mask.copy()
    out[(xs - x) ** 2 + (ys - y) ** 2 <= (size / 2) ** 2] = value
    return out


def ticks(low: float, high: float, bins: int = 256) -> list[float]:
    """Evenly spaced values for a colour bar: of 2 to 7 steps the most whose number divides the bins best."""
    steps = min(range(7, 1, -1), key=lambda k: (bins - 1) % k)
    return [low + (high - low) * k / steps for k in range(steps + 1)]
