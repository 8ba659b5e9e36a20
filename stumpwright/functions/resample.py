"""Resizing and warping of gray images over Arrow batches."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def _cubic(a: float):
    def kernel(x: np.ndarray) -> np.ndarray:
        x = np.abs(x)
        near = ((a + 2) * x - (a + 3)) * x * x + 1
        far = ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
        return np.where(x < 1, near, np.where(x < 2, far, 0.0))

    return kernel


#: name -> (kernel, support, whether the support grows when an image shrinks)
KERNELS = {"bilinear": (_triangle, 1.0, True), "bicubic": (_cubic(-0.75), 2.0, False)}


@lru_cache(256)
def weights(n_in: int, n_out: int, kind: str = "bilinear") -> np.ndarray:
    """(n_out, n_in) weights of a one-dimensional resize about pixel centres, edges repeated."""
    kernel, support, grows = KERNELS[kind]
    ratio = n_in / n_out
    spread = max(ratio, 1.0) if grows else 1.0
    out = np.zeros((n_out, n_in))
    for i in range(n_out):
        centre = (i + 0.5) * ratio - 0.5
        at = np.arange(int(np.floor(centre - support * spread)), int(np.ceil(centre + support * spread)) + 1)
        w = kernel((at - centre) / spread)
        if grows:
            inside = (at >= 0) & (at < n_in)
            at, w = at[inside], w[inside]
        np.add.at(out[i], np.clip(at, 0, n_in - 1), w)
    return out / out.sum(1, keepdims=True)


def _rounded(x: np.ndarray) -> np.ndarray:
    """Pixels, halves up; a half that sums missed by their own rounding is one."""
    return np.clip(np.floor(np.round(x, 9) + 0.5), 0, 255).astype(np.int32)


def resize_array(a: np.ndarray, h: int, w: int, kind: str = "bilinear") -> np.ndarray:
    if a.shape == (h, w):
        return a.astype(np.int32)
    return _rounded(weights(a.shape[0], h, kind) @ a @ weights(a.shape[1], w, kind).T)


def warp_array(a: np.ndarray, m: tuple[float, float, float, float], size: int) -> np.ndarray:
    """size x size image under x' = p x - q y + tx, y' = q x + p y + ty (m = p, q, tx, ty), bicubic,
    edges repeated."""
    p, q, tx, ty = m
    n = p * p + q * q
    y, x = np.mgrid[0:size, 0:size].astype(float)
    sx, sy = (p * (x - tx) + q * (y - ty)) / n, (p * (y - ty) - q * (x - tx)) / n
    fx, fy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    kernel, out = KERNELS["bicubic"][0], np.zeros((size, size))
    for dy in range(-1, 3):
        for dx in range(-1, 3):
            value = a[np.clip(fy + dy, 0, a.shape[0] - 1), np.clip(fx + dx, 0, a.shape[1] - 1)]
            out += value * kernel(sy - fy - dy) * kernel(sx - fx - dx)
    return _rounded(out)


def png_bytes(a: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    h, w = a.shape
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    lines = b"".join(b"\0" + row.tobytes() for row in a.astype(np.uint8))
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@F.pandas_udf(ArrayType(IntegerType()))
def resized(px: pd.Series, h: pd.Series, w: pd.Series, new_h: pd.Series, new_w: pd.Series, kind: pd.Series) -> pd.Series:
    """Row-major pixels at another size."""
    return pd.Series([resize_array(np.asarray(p, float).reshape(a, b), c, d, k).ravel() for p, a, b, c, d, k in zip(px, h, w, new_h, new_w, kind)])


@F.pandas_udf(ArrayType(IntegerType()))
def warped(px: pd.Series, h: pd.Series, w: pd.Series, m: pd.DataFrame, size: pd.Series) -> pd.Series:
    """Row-major pixels under a similarity (struct a, b, tx, ty)."""
    rows = zip(px, h, w, m.itertuples(index=False), size)
    return pd.Series([warp_array(np.asarray(p, float).reshape(a, b), tuple(t), s).ravel() for p, a, b, t, s in rows])


def outlined(a: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The image with a white outline a pixel wide on each box (x1, y1, x2, y2), cut at the edges."""
    out, (h, w) = a.copy(), a.shape
    for x1, y1, x2, y2 in np.asarray(boxes, float).reshape(-1, 4).astype(int):
        x, y = slice(max(x1, 0), max(min(x2 + 1, w), 0)), slice(max(y1, 0), max(min(y2 + 1, h), 0))
        for row in (y1, y2):
            if 0 <= row < h:
                out[row, x] = 255
        for column in (x1, x2):
            if 0 <= column < w:
                out[y, column] = 255
    return out


@F.pandas_udf(BinaryType())
def annotated(px: pd.Series, w: pd.Series, boxes: pd.Series) -> pd.Series:
    """Gray PNG files of row-major pixels with boxes (x1, y1, x2, y2 one after the other) drawn on them."""
    return pd.Series([png_bytes(outlined(np.asarray(p).reshape(-1, n), b)) for p, n, b in zip(px, w, boxes)])


@F.pandas_udf(BinaryType())
def png(px: pd.Series, w: pd.Series) -> pd.Series:
    """Gray PNG files of row-major pixels."""
    return pd.Series([png_bytes(np.asarray(p).reshape(-1, n)) for p, n in zip(px, w)])
