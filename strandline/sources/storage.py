"""Local storage and file-system formats."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import types as T

from strandline.functions.chunks import FormatError, read_container
from strandline.functions.hashes import lookup3
from strandline.sources.binary import FORMATS, _B, _I, _L, _S, _In, _schema, build_local_records, build_log, parse_local_records, parse_log

# --- the local index file: a guarded header, guarded records, and the log at the next 64 KiB -----------------

LOG_ALIGN = 0x10000


def build_local_index(bucket: int, rows: list[tuple], log: list[tuple] = ()) -> bytes:
    """SNK-18: rows (ekey9, archive, offset, size) and log rows (ekey9, archive, offset, size, status)."""
    head = struct.pack("<HBBBBBBQ", 7, bucket, 0, 4, 5, 9, 30, 1 << 30)
    body = build_local_records(rows)
    guard = lambda b: struct.pack("<II", len(b), int(lookup3([b])[0][0]))
    out = guard(head) + head + bytes(8) + guard(body) + body
    return out.ljust(-(-len(out) // LOG_ALIGN) * LOG_ALIGN, b"\0") + build_log(list(log)) if log else out


def parse_local_index(data: bytes) -> tuple[int, list[tuple], list[tuple]]:
    """SRC-36, 63: bucket, records and log."""
    if len(data) < 40 or struct.unpack_from("<I", data)[0] != 16:
        raise FormatError("not a local index")
    version, bucket, _, w_size, w_loc, w_key, bits, _ = struct.unpack_from("<HBBBBBBQ", data, 8)
    if (w_size, w_loc, w_key, bits) != (4, 5, 9, 30) or version != 7:
        raise FormatError("a local index of another layout")
    n, digest = struct.unpack_from("<II", data, 32)
    body = data[40 : 40 + n]
    if len(body) != n or int(lookup3([body])[0][0]) != digest:
        raise FormatError("a local index is damaged")
    return bucket, parse_local_records(body), parse_log(data[-(-(40 + n) // LOG_ALIGN) * LOG_ALIGN :])


# --- residency: buckets of pages of guarded records ---------------------------------------------------------

# Update types by number.
UPDATES = {0: "Invalid", 1: "Set", 2: "Create", 3: "Delete", 6: "MarkResident", 7: "MarkNonResident"}
_UPDATE_CODE = {v: k for k, v in UPDATES.items()}


def build_residency(rows: list[tuple]) -> bytes:
    """SNK-21: rows (bucket, ekey16, update_type, (offset, length, r1, r2)), 25 to a page of 1024 bytes."""
    out = []
    for b in range(16):
        bodies = [k + struct.pack(">4i", *span) + bytes([_UPDATE_CODE[u]]) + bytes(3) for bk, k, u, span in rows if bk == b]
        guards = (lookup3([x[:33] for x in bodies])[0] | np.uint32(0x80000000)) if bodies else []
        recs = [struct.pack("<I", int(g)) + x for g, x in zip(guards, bodies, strict=True)]
        pages = [b"".join(recs[i : i + 25]).ljust(1024, b"\0") for i in range(0, len(recs), 25)]
        out.append(bytes([b]) + struct.pack("<I", len(pages)) + b"".join(pages))
    return b"".join(out)


def parse_residency(data: bytes) -> list[tuple]:
    """SRC-44: (bucket, seq, ekey, update_type, span)."""
    out, at = [], 0
    while at + 5 <= len(data):
        bucket, pages = data[at], struct.unpack_from("<I", data, at + 1)[0]
        at += 5
        if bucket > 15:
            break
        for _ in range(pages):
            for i in range(25):
                raw = data[at + 40 * i : at + 40 * i + 40]
                if len(raw) == 40 and raw[3] & 0x80:
                    out.append((bucket, len(out), raw[4:20], UPDATES.get(raw[36], "Invalid"), struct.unpack_from(">4i", raw, 20)))
            at += 1024
    return out


# --- the LRU table: a doubly linked list in a flat array -----------------------------------------------------

NONE = 0xFFFFFFFF


def build_lru(keys: list[bytes], flags: list[int] | None = None) -> bytes:
    """SNK-22, 41: keys from the most recently used on."""
    n = len(keys)
    head = struct.pack("<HH16sII", 1, 0, bytes(16), 0 if n else NONE, n - 1 if n else NONE)
    body = b"".join(struct.pack("<II9sB2x", i - 1 if i else NONE, i + 1 if i + 1 < n else NONE, k, flags[i] if flags else 0) for i, k in enumerate(keys))
    raw = head + body
    return raw[:4] + hashlib.md5(raw).digest() + raw[20:]


def parse_lru(data: bytes) -> list[tuple] | None:
    """SRC-45: (place, ekey9, flags), the most recent first; None for a bad size or digest."""
    if len(data) < 28 or (len(data) - 28) % 20 or hashlib.md5(data[:4] + bytes(16) + data[20:]).digest() != data[4:20]:
        return None
    n = (len(data) - 28) // 20
    at, out = struct.unpack_from("<I", data, 20)[0], []
    while at < n and len(out) < n:  # a cycle ends the walk
        _, nxt, key, flag = struct.unpack_from("<II9sB", data, 28 + 20 * at)
        out.append((len(out), key, flag))
        at = nxt
    return out


# --- local blobs -----------------------------------------------------------------------------------------------

#: Fixed value: the seed of the first checksum.
SEED_A = 0x3D6BE971


def _sum_b(raw: bytes, base: int) -> int:
    out = bytearray(4)
    for i, b in enumerate(raw):
        out[(base + i) & 3] ^= b
    return int.from_bytes(out, "little")


def build_local_header(ekey: bytes, size: int, base: int = 0, flags: int = 0) -> bytes:
    """SNK-20, 40; SCL-40: the 30 bytes before a blob of ``size`` bytes at offset ``base``."""
    raw = ekey[::-1] + struct.pack(">I", size + 30) + struct.pack("<H", flags)
    raw += struct.pack("<I", int(lookup3([raw], SEED_A)[0][0]))
    return raw + struct.pack("<I", _sum_b(raw, base))


def parse_local_header(data: bytes, base: int = 0) -> dict | None:
    """SRC-42: key, size with header, flags, and whether both checksums hold; None if too short."""
    if len(data) < 30:
        return None
    a, b = struct.unpack_from("<II", data, 22)
    return {"ekey": data[:16][::-1], "size": struct.unpack_from(">I", data, 16)[0], "flags": struct.unpack_from("<H", data, 20)[0], "valid": int(lookup3([data[:22]], SEED_A)[0][0]) == a and _sum_b(data[:26], base) == b}


def parse_segment_headers(data: bytes) -> list[dict] | None:
    """SRC-43: the sixteen local headers at the start of a segment."""
    return [parse_local_header(data[30 * i : 30 * i + 30], 30 * i) for i in range(16)] if len(data) >= 480 else None


def read_local_content(data: bytes, keys: dict[int, bytes] | None = None) -> bytes:
    """SRC-41: content behind a local header, or of a bare container, or else the bytes as they are."""
    for skip in (30, 0):
        if data[skip : skip + 4] == b"BLTE":
            return read_container(data[skip:], keys)
    return data


# --- patch archives --------------------------------------------------------------------------------------------


def build_patch_archive(entries: list[tuple], block_entries: int = 64, info: tuple | None = None) -> bytes:
    """SNK-13: entries (target, size, [(source, source_size, patch, patch_size, index)]), sorted, in blocks that end with 0.

    ``info`` is (ckey, ekey, decoded_size, encoded_size, spec) of the encoding table.
    """
    entries = sorted(entries)
    blocks = [entries[i : i + block_entries] for i in range(0, len(entries), block_entries)]
    bodies = [b"".join(bytes([len(p)]) + t + s.to_bytes(5, "big") + b"".join(a + n.to_bytes(5, "big") + k + struct.pack(">IB", z, x) for a, n, k, z, x in p) for t, s, p in b) + b"\0" for b in blocks]
    head = b"PA" + struct.pack(">BBBBBHB", 2, 16, 16, 16, 16, len(blocks), 2 if info else 0)
    if info:
        head += info[0] + info[1] + struct.pack(">IIB", info[2], info[3], len(info[4])) + info[4].encode()
    at, table = len(head) + 36 * len(blocks), b""
    for b, raw in zip(blocks, bodies, strict=True):
        table += b[-1][0] + hashlib.md5(raw).digest() + struct.pack(">I", at)
        at += len(raw)
    return head + table + b"".join(bodies)


def parse_patch_archive(data: bytes) -> list[tuple]:
    """SRC-26, 57; PRJ-14; VAL-20; WIN-13: edges (target, decoded_size, source, source_size, patch, patch_size, patch_index)."""
    r = _In(data)
    if r.take(2) != b"PA":
        raise FormatError("not a patch archive")
    version, kf, ko, kp, bits, n, flags = r.uint(1), r.uint(1), r.uint(1), r.uint(1), r.uint(1), r.uint(2), r.uint(1)
    if not 1 <= version <= 2 or not all(1 <= k <= 16 for k in (kf, ko, kp)) or not 12 <= bits <= 24:
        raise FormatError("a patch archive's header is broken")
    if flags & 2:
        r.take(2 * kf + 8)
        r.take(r.uint(1))
    blocks = [(r.take(kf), r.take(16), r.uint(4)) for _ in range(n)]
    for i in range(1, n):
        if blocks[i - 1][0] > blocks[i][0]:
            raise FormatError(f"block {i} is out of order")
    out = []
    for _, digest, at in blocks:
        b = _In(data, at)
        while k := b.uint(1):
            target, size = b.take(kf), b.uint(5)
            out += [(target, size, b.take(ko), b.uint(5), b.take(kp), b.uint(4), b.uint(1)) for _ in range(k)]
        if hashlib.md5(data[at : b.at]).digest() != digest:
            raise FormatError("a block is damaged")
    return out


# --- the virtual file system -----------------------------------------------------------------------------------


def _width(table: int) -> int:
    """Bytes that address a table of this size."""
    return 1 if table <= 0xFF else 2 if table <= 0xFFFF else 3 if table <= 0xFFFFFF else 4


def _tree(paths: dict[str, int]) -> dict:
    root: dict = {}
    for path, value in paths.items():
        *folders, name = path.split("/")
        at = root
        for f in folders:
            at = at.setdefault(f, {})
            if not isinstance(at, dict):
                raise FormatError("a file is also a folder")
        at[name] = value
    return root


def _tree_bytes(node: dict) -> bytes:
    out = []
    for name, sub in sorted(node.items()):
        raw = name.encode()
        if not 0 < len(raw) < 255:
            raise FormatError("a name has 1 to 254 bytes")
        body = _tree_bytes(sub) if isinstance(sub, dict) else b""
        value = 0x80000000 | (len(body) + 4) if isinstance(sub, dict) else sub
        out.append(b"\0" + bytes([len(raw)]) + raw + b"\xff" + struct.pack(">I", value) + body)
    return b"".join(out)


def build_vfs(files: dict[str, list[tuple[int, int, int]]], containers: list[tuple[bytes, int]]) -> bytes:
    """SNK-15, 32: files with spans (file_offset, length, container number), and containers (ekey9, encoded_size)."""
    cft = b"".join(k + struct.pack(">I", s) for k, s in containers)
    w, vfs, where = _width(len(cft)), b"", {}
    for path, spans in sorted(files.items()):
        if len(spans) > 224:
            raise FormatError("a file has more than 224 spans")
        where[path] = len(vfs)
        vfs += bytes([len(spans)]) + b"".join(struct.pack(">II", o, n) + (13 * c).to_bytes(w, "big") for o, n, c in spans)
    tree = _tree_bytes(_tree(where))
    paths = b"\xff" + struct.pack(">I", 0x80000000 | (len(tree) + 4)) + tree
    depth = max((p.count("/") + 1 for p in files), default=0)
    head = b"TVFS" + struct.pack(">BBBBI", 1, 38, 9, 9, 0)
    at = 38
    for t in (paths, vfs, cft):
        head += struct.pack(">II", at, len(t))
        at += len(t)
    return head + struct.pack(">H", depth) + paths + vfs + cft


def _paths(data: bytes, at: int, end: int, prefix: str, out: list[tuple[str, int]]) -> None:
    """SRC-29: names are fragments between separators; a node's value follows 0xFF."""
    while at < end:
        parts = []
        while at < end and data[at] != 0xFF:
            n = data[at]
            at += 1
            if n:
                parts.append(data[at : at + n])
                at += n
        if at + 5 > end or any(not p for p in parts):
            raise FormatError("a path table is cut off")
        value = int.from_bytes(data[at + 1 : at + 5], "big")
        name = "/".join(x for x in (prefix, b"/".join(parts).decode("utf-8", "replace")) if x)
        at += 5
        if value & 0x80000000:
            size = (value & 0x7FFFFFFF) - 4
            if size < 0 or at + size > end:
                raise FormatError("a folder is cut off")
            _paths(data, at, at + size, name, out)
            at += size
        else:
            out.append((name, value))


def parse_vfs(data: bytes) -> dict:
    """SRC-28..31, 61; VAL-21: paths (path, vfs_offset), spans (offset, [(file_offset, span_length, cft_offset)]), containers."""
    if data[:4] == b"BLTE":
        data = read_container(data)
    if data[:4] != b"TVFS" or len(data) < 38:
        raise FormatError("not a virtual file system")
    version, _, ek, pk = data[4:8]
    flags, *tables = struct.unpack_from(">7I", data, 8)
    if version != 1 or not 1 <= ek <= 16 or any(o + n > len(data) for o, n in zip(tables[::2], tables[1::2], strict=True)):
        raise FormatError("a virtual file system's header is broken")
    paths, vfs, cft = (data[o : o + n] for o, n in zip(tables[::2], tables[1::2], strict=True))
    est = struct.unpack_from(">I", data, 42)[0] if flags & 2 else 0
    w = _width(len(cft))
    found: list[tuple[str, int]] = []
    _paths(paths, 0, len(paths), "", found)
    spans, at = [], 0
    while at < len(vfs):
        n, start = vfs[at], at
        r = _In(vfs, at + 1)
        if n > 224:  # deleted or of another kind
            at += 1 + n * (8 + w)
            continue
        spans.append((start, [(r.uint(4), r.uint(4), r.uint(w)) for _ in range(n)]))
        at = r.at
    size = ek + 4 + (pk if flags & 1 else 0) + (_width(est) if flags & 2 else 0) + (w if flags & 4 else 0)
    containers = []
    for o in range(0, len(cft) - size + 1, size):
        r = _In(cft, o)
        containers.append((o, r.take(ek), r.uint(4), r.take(pk) if flags & 1 else None, r.uint(_width(est)) if flags & 2 else None, r.uint(w) if flags & 4 else None))
    return {"paths": found, "spans": spans, "containers": containers}


_SPAN = T.StructType([T.StructField(n, _L) for n in ("file_offset", "span_length", "cft_offset")])
_RES = T.StructType([T.StructField(n, _I) for n in ("offset", "length", "reserved1", "reserved2")])


def _spans(b: bytes) -> list[tuple]:
    return [(o, [dict(zip(_SPAN.names, s, strict=True)) for s in sp]) for o, sp in parse_vfs(b)["spans"]]


FORMATS |= {
    "local_index": (_schema(bucket=_I, pos=_L, ekey9=_B, archive_id=_I, offset=_L, size=_L), lambda b: [(i, *r) for i, rows, _ in [parse_local_index(b)] for r in rows]),
    "local_index_log": (_schema(bucket=_I, seq=_L, ekey9=_B, archive_id=_I, offset=_L, size=_L, status=_S), lambda b: [(i, *r) for i, _, log in [parse_local_index(b)] for r in log]),
    "residency": (_schema(bucket=_I, seq=_L, ekey=_B, update_type=_S, span=_RES), lambda b: [(*r[:4], dict(zip(_RES.names, r[4], strict=True))) for r in parse_residency(b)]),
    "lru": (_schema(place=_L, ekey9=_B, flags=_I), lambda b: parse_lru(b) or []),
    "patch_edges": (_schema(target_ckey=_B, decoded_size=_L, source_ekey=_B, source_size=_L, patch_ekey=_B, patch_size=_L, patch_index=_I), parse_patch_archive),
    "vfs_paths": (_schema(path=_S, vfs_offset=_L), lambda b: parse_vfs(b)["paths"]),
    "vfs_spans": (_schema(offset=_L, spans=T.ArrayType(_SPAN)), _spans),
    "vfs_containers": (_schema(offset=_L, ekey=_B, encoded_size=_L, content_key=_B, est_index=_L, patch_offset=_L), lambda b: parse_vfs(b)["containers"]),
}
