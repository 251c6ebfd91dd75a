"""Hashes and stream ciphers that Spark lacks, as Arrow-batched functions.

Values of a batch are hashed together: numpy runs over the n-th block of every value at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = np.uint32


def _rot(x, k):
    return (x << _M(k)) | (x >> _M(32 - k))


# The rotations of the public-domain lookup3 mixing steps.
_MIX = (4, 6, 8, 16, 19, 4)
_FINAL = (14, 11, 25, 16, 4, 14, 24)


def _mix(v):
    x, y, z = v
    for r in _MIX:
        x = (x - z) ^ _rot(z, r)
        z = z + y
        x, y, z = y, z, x
    return [x, y, z]


def _final(v):
    x, y, z = v
    for r in _FINAL:
        z = (z ^ y) - _rot(y, r)
        x, y, z = y, z, x
    return [x, y, z]


def lookup3(values: list[bytes], first: int = 0, second: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Both 32-bit results of the lookup3 hash of each value, for the given seeds."""
    n = len(values)
    size = np.array([len(v) for v in values], np.int64)
    blocks = max(1, int(-(-size.max(initial=0) // 12)))
    raw = np.zeros((n, blocks * 12), np.uint8)
    for i, v in enumerate(values):
        raw[i, : len(v)] = np.frombuffer(v, np.uint8)
    words = raw.view("<u4").astype(np.uint32).reshape(n, blocks, 3)
    with np.errstate(over="ignore"):
        start = _M(0xDEADBEEF) + size.astype(np.uint32) + _M(first)
        state = [start.copy(), start.copy(), start + _M(second)]
        out = [state[1].copy(), state[2].copy()]
        for k in range(blocks):
            live = np.flatnonzero(size > 12 * k)
            cur = [s[live] + words[live, k, i] for i, s in enumerate(state)]
            last = size[live] <= 12 * (k + 1)
            done = _final([c[last] for c in cur])
            # seven final steps leave the roles rotated by one
            done = [done[2], done[0], done[1]]
            out[0][live[last]], out[1][live[last]] = done[1], done[2]
            more = _mix([c[~last] for c in cur])
            for s, c in zip(state, more, strict=True):
                s[live[~last]] = c
    return out[1], out[0]


def _bytes(s: pd.Series) -> list[bytes]:
    return [bytes(v) if v is not None else b"" for v in s]


def _null(s: pd.Series, out: np.ndarray) -> pd.Series:
    r = pd.Series(out, dtype="Int64")
    r[s.isna().to_numpy()] = pd.NA
    return r


def hash32(data: Column, seed: int = 0) -> Column:
    """SCL-03: 32-bit hash of binary values, as an unsigned number."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return _null(s, lookup3(_bytes(s), seed)[0].astype(np.int64))

    return run(data.cast("binary"))


def hash64(data: Column) -> Column:
    """SCL-02, SCL-37: both results as the bit pattern of one 64-bit number, the first one high."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        c, b = lookup3(_bytes(s))
        return _null(s, ((c.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)).view(np.int64))

    return run(data.cast("binary"))


def path_hash(path: Column) -> Column:
    """SCL-01, SCL-35: hash of a path, upper case and with backslashes; always normalised."""
    return hash64(F.translate(F.upper(path), "/", "\\"))


def murmur_final(x: Column) -> Column:
    """SCL-10: the 64-bit finaliser of MurmurHash3."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        k = s.fillna(0).to_numpy(np.int64).view(np.uint64)
        # The two multipliers of the finaliser.
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            k = (k ^ (k >> np.uint64(33))) * np.uint64(m)
        return _null(s, (k ^ (k >> np.uint64(33))).view(np.int64))

    return run(x)


def arc4(data: bytes, key: bytes) -> bytes:
    """SCL-27: the ARC4 stream of a key over the data."""
    s = list(range(256))
    j = 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray(len(data))
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def salsa20(data: bytes, key: bytes, iv: bytes, block_index: int = 0) -> bytes:
    """SCL-26, 46: Salsa20 with a 16-byte key and a 4 or 8 byte nonce that the chunk's number changes.

    All 64-byte blocks are computed at once: each word of the state is an array over blocks.
    """
    if len(key) != 16 or len(iv) not in (4, 8):
        raise ValueError("a key has 16 bytes, a nonce 4 or 8")
    n = -(-len(data) // 64)
    nonce = bytearray(iv.ljust(8, b"\0"))
    for i, b in enumerate((block_index & 0xFFFFFFFF).to_bytes(4, "little")):
        nonce[i] ^= b
    k, v = np.frombuffer(key, "<u4"), np.frombuffer(bytes(nonce), "<u4")
    c = np.frombuffer(b"expand 16-byte k", "<u4")
    count = np.arange(n, dtype=np.uint64)
    fixed = {0: c[0], 5: c[1], 10: c[2], 15: c[3], 6: v[0], 7: v[1]} | {i + 1: k[i] for i in range(4)} | {i + 11: k[i] for i in range(4)}
    start = [np.full(n, fixed[i], np.uint32) if i in fixed else (count >> np.uint64(32 * (i - 8))).astype(np.uint32) for i in range(16)]
    x = [s.copy() for s in start]
    # The words of each quarter round, columns then rows, and the rotations.
    quarters = ((0, 4, 8, 12), (5, 9, 13, 1), (10, 14, 2, 6), (15, 3, 7, 11), (0, 1, 2, 3), (5, 6, 7, 4), (10, 11, 8, 9), (15, 12, 13, 14))
    with np.errstate(over="ignore"):
        for _ in range(10):
            for q in quarters:
                for step, r in enumerate((7, 9, 13, 18)):
                    to, p, s = q[(step + 1) % 4], q[step], q[(step + 3) % 4]
                    x[to] ^= _rot(x[p] + x[s], r)
        stream = np.stack([a + s for a, s in zip(x, start, strict=True)], 1).astype("<u4").tobytes()
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(stream, np.uint8)[: len(data)]).tobytes()
