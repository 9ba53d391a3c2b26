"""Transforms of images and masks, as numpy kernels over Arrow batches.

An image is a row (h, w, c, data BINARY, uint8, row by row). A kernel takes and gives an array [h, w, c]; `mapped` runs
one over a column of images. Where a transform draws parameters, the draw is a hash of the row's key and a seed, so that
an image and its mask, or a second run, get the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

IGNORED = 255
# Weights of red, green and blue in luminance.
LUMINANCE = (0.299, 0.587, 0.114)

SCHEMA = "h int, w int, c int, data binary"


def mapped(images: DataFrame, kernel: Callable[[np.ndarray, np.random.Generator], np.ndarray], key: str, seed: int = 0) -> DataFrame:
    """(key, h, w, c, data) with kernel applied to each image; a null image stays null."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h, w, c, data in zip(b[key], b["h"], b["w"], b["c"], b["data"]):
                if data is None:
                    out.append((k, None, None, None, None))
                    continue
                a = kernel(np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c)), generator(k, seed))
                out.append((k, *a.shape, a.astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=[key, "h", "w", "c", "data"]).astype({"h": "Int32", "w": "Int32", "c": "Int32"})

    return images.select(key, "h", "w", "c", "data").mapInPandas(run, f"{key} {kind}, {SCHEMA}")


def generator(key, seed: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{key}".encode()).digest()[:8], "big"))


def clipped(a: np.ndarray) -> np.ndarray:
    return np.clip(a, 0, 255).astype(np.uint8)


def grid_of(new: int, old: int) -> np.ndarray:
    """Centres of new cells in old ones."""
    return (np.arange(new) + 0.5) * old / new - 0.5


def sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray, nearest: bool, outside: int = 0) -> np.ndarray:
    """The image at places (y, x), bilinear or nearest; `outside` beyond the edge."""
    h, w = a.shape[:2]
    if nearest:
        iy, ix = np.floor(y + 0.5).astype(int), np.floor(x + 0.5).astype(int)
        out = a[np.clip(iy, 0, h - 1), np.clip(ix, 0, w - 1)].copy()
        out[(iy < 0) | (iy >= h) | (ix < 0) | (ix >= w)] = outside
        return out
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    at = lambda i, j: a[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)].astype(float)
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    out[(y < -0.5) | (y > h - 0.5) | (x < -0.5) | (x > w - 0.5)] = outside
    return np.floor(out + 0.5).astype(np.uint8)


def resized(a: np.ndarray, h: int, w: int, nearest: bool = False) -> np.ndarray:
    y, x = np.meshgrid(np.clip(grid_of(h, a.shape[0]), 0, a.shape[0] - 1), np.clip(grid_of(w, a.shape[1]), 0, a.shape[1] - 1), indexing="ij")
    return sampled(a, y, x, nearest)


def affine(a: np.ndarray, m: np.ndarray, nearest: bool = False, outside: int = 0) -> np.ndarray:
    """By the 2 x 3 matrix m, of places (x, y) in the old image to the new one of the same size."""
    back = np.linalg.inv(np.vstack([m, [0, 0, 1]]))
    y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
    return sampled(a, back[1, 0] * x + back[1, 1] * y + back[1, 2], back[0, 0] * x + back[0, 1] * y + back[0, 2], nearest, outside)


def warped(a: np.ndarray, dy: np.ndarray, dx: np.ndarray, nearest: bool = False, outside: int = 0) -> np.ndarray:
    """Each place takes what lies (dy, dx) away."""
    y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
    return sampled(a, y + dy, x + dx, nearest, outside)


def luminance(a: np.ndarray) -> np.ndarray:
    """Gray, in as many channels as before."""
    gray = a[..., :3].astype(float) @ np.array(LUMINANCE) if a.shape[2] >= 3 else a[..., 0].astype(float)
    return np.repeat(clipped(np.floor(gray + 0.5))[..., None], a.shape[2], axis=2)


def bell(sigma: float, reach: int | None = None) -> np.ndarray:
    n = reach if reach is not None else max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    return k / k.sum()


def smoothed(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Along columns and rows, the edge mirrored."""
    n = len(kernel) // 2
    out = a.astype(float)
    for axis in (0, 1):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (n, n)
        wide = np.pad(out, pad, mode="symmetric")
        out = sum(k * np.take(wide, np.arange(i, i + out.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return out


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    return clipped(smoothed(a, bell(sigma)))


def blended(a: np.ndarray, other, other_weight: float, weight: float) -> np.ndarray:
    """weight of the image and other_weight of the other, cut to 0..255 and to whole numbers."""
    return clipped(other_weight * np.asarray(other, float) + weight * a.astype(float))


def brightness(a: np.ndarray, by: float) -> np.ndarray:
    return blended(a, 0.0, 1 - by, by)


def contrast(a: np.ndarray, by: float) -> np.ndarray:
    return blended(a, a.mean(), 1 - by, by)


def saturation(a: np.ndarray, by: float) -> np.ndarray:
    return blended(a, luminance(a), 1 - by, by)


def inverted(a: np.ndarray) -> np.ndarray:
    return blended(a, 255.0, 1.0, -1.0)


def hue(a: np.ndarray, turn: float) -> np.ndarray:
    """Hue turned by a share of the circle; a turn by minus that undoes it, but for rounding."""
    rgb = a[..., :3].astype(float) / 255
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    span = top - low
    r, g, b = np.moveaxis(rgb, 2, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        h = np.select([span == 0, top == r, top == g], [0.0, ((g - b) / span) % 6, (b - r) / span + 2], (r - g) / span + 4) / 6
    h = (h + turn) % 1
    k = lambda n: (n + h * 6) % 6
    out = np.stack([top - span * np.clip(np.minimum(k(n), 4 - k(n)), 0, 1) for n in (5, 3, 1)], axis=2)
    return np.concatenate([np.floor(out * 255 + 0.5).astype(np.uint8), a[..., 3:]], axis=2)


def thresholded(a: np.ndarray, window: int = 11, less: float = 2) -> np.ndarray:
    """255 where the gray is over its bell-weighted surroundings less `less`."""
    gray = luminance(a)[..., 0].astype(float)
    around = smoothed(gray, bell(0.3 * ((window - 1) * 0.5 - 1) + 0.8, window // 2))
    return np.repeat(np.where(gray > around - less, 255, 0).astype(np.uint8)[..., None], a.shape[2], axis=2)


def cropped(a: np.ndarray, y: int, x: int, h: int, w: int) -> np.ndarray:
    return a[y : y + h, x : x + w]


def padded(a: np.ndarray, top: int, bottom: int, left: int, right: int, value: int = 0) -> np.ndarray:
    return np.pad(a, ((top, bottom), (left, right), (0, 0)), constant_values=value)


def clipped_polygon(pts: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A polygon cut to a box, side by side of the box; fewer than three corners: none."""
    out = [tuple(p) for p in pts]
    for axis, limit, above in ((0, x0, True), (0, x1, False), (1, y0, True), (1, y1, False)):
        ring, out = out, []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ins = [(p[axis] >= limit) if above else (p[axis] <= limit) for p in (a, b)]
            if ins[0]:
                out.append(a)
            if ins[0] != ins[1]:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(a[i] + t * (b[i] - a[i]) for i in (0, 1)))
    return np.array(out) if len(out) > 2 else np.zeros((0, 2))
