"""Vectorised 64-bit hashes over the bytes of a batch of texts, with numpy alone.

``Bytes`` holds a block of texts as one byte array. Hashes of substrings come from polynomial prefix sums
modulo 2**64 with a finaliser, so any span's hash costs one subtraction and one multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INV = pow(BASE, -1, 1 << 64)
_POW = {"n": 0, "p": np.ones(1, _U), "i": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply and xor-shift)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least; up to a megabyte of text they are kept between calls."""
    if _POW["n"] < n:
        m = max(n, 1 << 16)
        p, i = np.full(m, BASE, _U), np.full(m, INV, _U)
        p[0] = i[0] = 1
        p, i = np.cumprod(p, dtype=_U), np.cumprod(i, dtype=_U)
        if m > (1 << 20) + 64:
            return p, i
        _POW.update(n=m, p=p, i=i)
    return _POW["p"], _POW["i"]


class SpanHash:
    """Hashes of spans [start, end) of ``data``."""

    def __init__(self, data: np.ndarray):
        p, self.inv = powers(len(data) + 1)
        self.sum = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * p[: len(data)], out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sum[end] - self.sum[start]) * self.inv[start]
        return mix(h + (end - start).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold ``limit`` bytes at most (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = text_bytes(batch.column(column))[1]
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, none across texts, and each text's first word.

    ``is_word`` is a table of 256 booleans; the third result has len(off) entries.
    """
    w = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = w
    now = np.empty(len(data) + 1, bool)
    now[:-1] = w
    now[-1] = False
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    return starts, ends, np.searchsorted(starts, off)
