"""The chunk container and the binary delta codec.

A container is a list of chunks, each stored, deflated, LZ4-packed or encrypted. Functions work on bytes; the
``*_column`` ones apply them to batches of binary values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.hashes import arc4, salsa20
from strandline.functions.suffixes import longest_matches, longest_matches_many

# Magic bytes, chunk modes, cipher letters, limits.
MAGIC = b"BLTE"
MODES = {"stored": b"N", "zlib": b"Z", "lz4": b"4", "encrypted": b"E"}
CIPHERS = {"salsa20": b"S", "arc4": b"A"}
MAX_CHUNK = 1 << 30
DELTA_MAGIC = b"ZBSDIFF1"
MAX_DELTA, MAX_STEP = 1_000_000_000, 10_000_000


class FormatError(ValueError):
    """Input that is not in the format it should be in."""


def pack_chunk(data: bytes, mode: str = "zlib") -> bytes:
    """SCL-22: a mode byte and the packed data."""
    if mode == "stored":
        return b"N" + data
    if mode == "zlib":
        return b"Z" + zlib.compress(data)
    if mode == "lz4":
        return b"4" + struct.pack("<Q", len(data)) + (pa.compress(data, codec="lz4_raw", asbytes=True) if data else b"\0")
    raise FormatError(f"no such packing: {mode}")


def unpack_chunk(chunk: bytes, keys: dict[int, bytes] | None = None, index: int = 0, nested: bool = False) -> bytes:
    """SCL-23 and SCL-25: the data of a chunk. ``keys`` by number for encrypted ones."""
    mode, body = chunk[:1], chunk[1:]
    if mode == b"N":
        return body
    if mode == b"Z":
        d = zlib.decompressobj()
        out = d.decompress(body, MAX_CHUNK)
        if d.unconsumed_tail:
            raise FormatError("a chunk is too large")
        return out
    if mode == b"4":
        if len(body) < 8:
            raise FormatError("an LZ4 chunk has no size")
        (size,) = struct.unpack_from("<Q", body)
        if size > MAX_CHUNK:
            raise FormatError("a chunk is too large")
        return pa.decompress(body[8:], size, codec="lz4_raw", asbytes=True) if size else b""
    if mode == b"E":
        if nested:
            raise FormatError("an encrypted chunk within another")
        return _decrypt(body, keys or {}, index)
    raise FormatError(f"unknown chunk mode {mode!r}")


def encrypt_chunk(packed: bytes, key_id: int, key: bytes, iv: bytes, index: int = 0, cipher: str = "salsa20") -> bytes:
    """SCL-24: an encrypted chunk around a packed one."""
    body = salsa20(packed, key, iv, index) if cipher == "salsa20" else arc4(packed, key)
    return b"E\x08" + struct.pack("<Q", key_id) + bytes([len(iv)]) + iv + CIPHERS[cipher] + body


def _decrypt(body: bytes, keys: dict[int, bytes], index: int) -> bytes:
    if len(body) < 15 or body[0] != 8:
        raise FormatError("an encrypted chunk's header is broken")
    (key_id,) = struct.unpack_from("<Q", body, 1)
    n = body[9]
    if n not in (4, 8) or len(body) < 11 + n:
        raise FormatError("an encrypted chunk's nonce is broken")
    if key_id not in keys:
        raise FormatError(f"no key {key_id:016X}")
    iv, kind, data = body[10 : 10 + n], body[10 + n : 11 + n], body[11 + n :]
    if kind == CIPHERS["salsa20"]:
        plain = salsa20(data, keys[key_id], iv, index)
    elif kind == CIPHERS["arc4"]:
        plain = arc4(data, keys[key_id])
    else:
        raise FormatError(f"unknown cipher {kind!r}")
    return unpack_chunk(plain, nested=True) if plain else plain


def build_container(data: bytes, chunk_size: int = 1 << 18, mode: str = "zlib", encrypt: Callable[[bytes, int], bytes] | None = None, single: bool = False) -> bytes:
    """SNK-16, 17, 39: splits, packs and, by ``encrypt(packed, index)``, encrypts; ``single`` writes no chunk table."""
    parts = [data[i : i + chunk_size] for i in range(0, len(data), chunk_size)] or [b""]
    if single and len(parts) > 1:
        raise FormatError("a container without table has one chunk")
    packed = [pack_chunk(p, mode) for p in parts]
    if encrypt:
        packed = [encrypt(p, i) for i, p in enumerate(packed)]
    if single:
        return MAGIC + struct.pack(">I", 0) + packed[0]
    head = b"\x0f" + len(packed).to_bytes(3, "big")
    head += b"".join(struct.pack(">II", len(p), len(d)) + hashlib.md5(p).digest() for p, d in zip(packed, parts, strict=True))
    return MAGIC + struct.pack(">I", 8 + len(head)) + head + b"".join(packed)


def list_chunks(blob: bytes) -> list[dict]:
    """The chunks of a container: idx, mode, compressed_size, decompressed_size, checksum, data (with its mode byte)."""
    if blob[:4] != MAGIC or len(blob) < 9:
        raise FormatError("not a chunk container")
    (head,) = struct.unpack_from(">I", blob, 4)
    if head == 0:
        return [{"idx": 0, "mode": blob[8:9].decode("latin1"), "compressed_size": len(blob) - 8, "decompressed_size": None, "checksum": None, "data": blob[8:]}]
    flags, n = blob[8], int.from_bytes(blob[9:12], "big")
    width = {0x0F: 24, 0x10: 40}.get(flags)
    if width is None or head != 12 + n * width or n == 0:
        raise FormatError("a chunk table is broken")
    out, at = [], head
    for i in range(n):
        c, d = struct.unpack_from(">II", blob, 12 + i * width)
        body = blob[at : at + c]
        if len(body) != c:
            raise FormatError("a container ends early")
        out.append({"idx": i, "mode": body[:1].decode("latin1"), "compressed_size": c, "decompressed_size": d, "checksum": blob[20 + i * width : 36 + i * width], "data": body})
        at += c
    return out


def read_container(blob: bytes, keys: dict[int, bytes] | None = None, verify: bool = True) -> bytes:
    """SRC-32 and SRC-33: the content. A lone encrypted chunk without a table is refused."""
    chunks = list_chunks(blob)
    if chunks[0]["checksum"] is None and chunks[0]["mode"] == "E":
        raise FormatError("an encrypted chunk needs a chunk table")
    out = []
    for c in chunks:
        if verify and c["checksum"] is not None and hashlib.md5(c["data"]).digest() != c["checksum"]:
            raise FormatError(f"chunk {c['idx']} is damaged")
        out.append(unpack_chunk(c["data"], keys, c["idx"]))
    return b"".join(out)


CHUNK_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField("idx", T.IntegerType()), T.StructField("mode", T.StringType()), T.StructField("compressed_size", T.LongType()), T.StructField("decompressed_size", T.LongType()), T.StructField("checksum", T.BinaryType()), T.StructField("data", T.BinaryType())]
    )
)


def _each(kind, fn) -> Callable[..., Column]:
    @F.pandas_udf(kind)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else fn(*(bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else v for v in row)) for row in zip(*cols, strict=True)], dtype=object)

    return run


def container_column(data: Column, chunk_size: int = 1 << 18, mode: str = "zlib") -> Column:
    return _each("binary", lambda d: build_container(d, chunk_size, mode))(data)


def content_column(blob: Column, keys: dict[int, bytes] | None = None) -> Column:
    return _each("binary", lambda b: read_container(b, keys))(blob)


def chunks_column(blob: Column) -> Column:
    """Array of chunk structs, for ``explode``."""

    @F.udf(CHUNK_TYPE, useArrow=True)
    def run(b):
        return None if b is None else [tuple(c.values()) for c in list_chunks(bytes(b))]

    return run(blob)


# --- the delta codec ---------------------------------------------------------------------------------------


def _off_out(v: int) -> bytes:
    """Sign and magnitude, little-endian."""
    raw = bytearray(abs(v).to_bytes(8, "little"))
    raw[7] |= 0x80 if v < 0 else 0
    return bytes(raw)


def _off_in(raw: bytes) -> int:
    v = int.from_bytes(raw, "little")
    return -(v & ~(1 << 63)) if v >> 63 else v


def control_steps(packed: bytes) -> list[tuple[int, int, int]]:
    """SRC-58: steps (diff, extra, seek), each checked (FLT-55)."""
    raw = zlib.decompress(packed)
    if not raw or len(raw) % 24:
        raise FormatError("a control block is empty or cut off")
    steps = [tuple(_off_in(raw[i + j : i + j + 8]) for j in (0, 8, 16)) for i in range(0, len(raw), 24)]
    if any(not (0 <= d <= MAX_STEP and 0 <= e <= MAX_STEP) for d, e, _ in steps):
        raise FormatError("a control step is out of bounds")
    return steps


def parse_delta(patch: bytes) -> tuple[list[tuple[int, int, int]], bytes, bytes, int]:
    """SRC-34, VAL-22: steps, diff bytes, extra bytes, size of the result."""
    if patch[:8] != DELTA_MAGIC or len(patch) < 32:
        raise FormatError("not a delta")
    c, d, size = struct.unpack_from("<qqq", patch, 8)
    if not (0 <= c <= MAX_DELTA and 0 <= d <= MAX_DELTA and 0 <= size <= MAX_DELTA and c + d <= MAX_DELTA):
        raise FormatError("a delta's sizes are out of bounds")
    return control_steps(patch[32 : 32 + c]), zlib.decompress(patch[32 + c : 32 + c + d]), zlib.decompress(patch[32 + c + d :]), size


def apply_delta(old: bytes, patch: bytes) -> bytes:
    """SCL-29, STR-05: the new bytes. Old bytes beyond its ends count as 0."""
    steps, diff, extra, size = parse_delta(patch)
    src, add = np.frombuffer(old, np.uint8), np.frombuffer(diff, np.uint8)
    out, at, d, e = [], 0, 0, 0
    for n, m, seek in steps:
        if d + n > len(diff) or e + m > len(extra):
            raise FormatError("a delta's data end early")
        base = np.zeros(n, np.uint8)
        lo, hi = max(0, at), min(len(src), at + n)
        if hi > lo:
            base[lo - at : hi - at] = src[lo:hi]
        out.append((base + add[d : d + n]).tobytes())
        out.append(extra[e : e + m])
        d, e, at = d + n, e + m, at + n + seek
    got = b"".join(out)
    if len(got) != size:
        raise FormatError("a delta's result has another size")
    return got


def _assemble(steps, diff: bytes, extra: bytes, size: int) -> bytes:
    c = zlib.compress(b"".join(_off_out(x) for s in steps for x in s))
    z = zlib.compress(diff)
    return DELTA_MAGIC + struct.pack("<qqq", len(c), len(z), size) + c + z + zlib.compress(extra)


def delta_simple(old: bytes, new: bytes) -> bytes:
    """SNK-38: everything new is extra."""
    steps = [(0, min(MAX_STEP, len(new) - i), 0) for i in range(0, len(new), MAX_STEP)] or [(0, 0, 0)]
    return _assemble(steps, b"", new, len(new))


def delta_chunked(old: bytes, new: bytes, size: int = 1 << 16) -> bytes:
    """SNK-37: aligned pieces, each a difference as far as the old data reaches."""
    steps, diff, extra = [], [], []
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    for i in range(0, len(new), size):
        j = min(len(new), i + size)
        k = max(i, min(j, len(old)))
        diff.append((b[i:k] - a[i:k]).tobytes())
        extra.append(new[k:j])
        steps.append((k - i, j - k, 0))
    return _assemble(steps or [(0, 0, 0)], b"".join(diff), b"".join(extra), len(new))


def delta_suffix(old: bytes, new: bytes, least: int = 16) -> bytes:
    """SNK-36, SCL-30: the longest matches by the suffix order of both, greedy from left to right."""
    return _from_matches(new, *longest_matches(old, new), least)


def _from_matches(new: bytes, size: np.ndarray, place: np.ndarray, least: int) -> bytes:
    steps, diff, extra = [], bytearray(), bytearray()
    good = np.flatnonzero(size >= least)
    at = k = 0
    runs: list[tuple[int, int, bytes]] = []  # old position, length, the extra bytes before
    while (k := k + int(np.searchsorted(good[k:], at))) < len(good):
        i = int(good[k])
        runs.append((int(place[i]), int(size[i]), new[at:i]))
        at = i + int(size[i])
    wait = new[at:]
    # a step is a difference and then extra bytes; its seek leads to the next difference
    lead = runs[0][2] if runs else wait
    if not runs:
        return delta_simple(b"", new)
    steps.append((0, len(lead), runs[0][0]))
    extra += lead
    for i, (p, n, _) in enumerate(runs):
        after = runs[i + 1][2] if i + 1 < len(runs) else wait
        nxt = runs[i + 1][0] if i + 1 < len(runs) else p + n
        diff += bytes(n)
        extra += after
        steps.append((n, len(after), nxt - (p + n)))
    if any(x > MAX_STEP for s in steps for x in s[:2]):
        return delta_simple(b"", new)
    return _assemble(steps, bytes(diff), bytes(extra), len(new))


#: Bytes of several pairs whose suffixes are sorted at once.
TOGETHER = 1 << 15


def delta_suffix_many(pairs: list[tuple[bytes, bytes] | None], least: int = 16) -> list[bytes | None]:
    """``delta_suffix`` of each pair; short pairs share a suffix array, which numpy builds in the time of one."""
    out: list[bytes | None] = [None] * len(pairs)
    block, total = [], 0
    for i, pair in enumerate(pairs):
        if pair is not None:
            block.append(i)
            total += len(pair[0]) + len(pair[1])
        if block and (total >= TOGETHER or i + 1 == len(pairs)):
            for j, found in zip(block, longest_matches_many([pairs[j] for j in block]), strict=True):
                out[j] = _from_matches(pairs[j][1], *found, least)
            block, total = [], 0
    return out


def delta_stats(patch: bytes) -> dict:
    """AGG-36, AGG-64: counts and sums over a delta's steps, and the mean absolute seek."""
    steps, _, _, size = parse_delta(patch)
    match, extra = sum(s[0] for s in steps), sum(s[1] for s in steps)
    seeks = [abs(s[2]) for s in steps]
    return {"steps": len(steps), "match_bytes": match, "extra_bytes": extra, "size": size, "match_percent": 100.0 * match / (match + extra) if match + extra else 100.0, "mean_seek": sum(seeks) / len(seeks)}


def apply_delta_column(old: Column, patch: Column) -> Column:
    return _each("binary", apply_delta)(old, patch)


def delta_column(old: Column, new: Column, method: str = "chunked") -> Column:
    if method == "suffix":

        @F.pandas_udf("binary")
        def run(old: pd.Series, new: pd.Series) -> pd.Series:
            return pd.Series(delta_suffix_many([None if a is None or b is None else (bytes(a), bytes(b)) for a, b in zip(old, new, strict=True)]), dtype=object)

        return run(old, new)
    return _each("binary", {"simple": delta_simple, "chunked": delta_chunked}[method])(old, new)


def delta_stats_column(patch: Column) -> Column:
    kind = "steps long, match_bytes long, extra_bytes long, size long, match_percent double, mean_seek double"

    @F.udf(kind, useArrow=True)
    def run(p):
        return None if p is None else delta_stats(bytes(p))

    return run(patch)
