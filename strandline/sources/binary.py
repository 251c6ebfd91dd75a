"""Binary formats: rows out of files and files out of rows.

Each format is a pair of functions over bytes, ``parse`` and ``build``, and a schema. ``read`` applies a parser
to the files of a folder on the executors, one file a row (``binaryFile``), so it works on any store; every
row has ``doc`` and its place, since "first in file" matters to lookups. Writers sort and checksum as the
formats ask and give back one blob for each group.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from strandline.functions.chunks import MAGIC, FormatError, read_container
from strandline.functions.hashes import lookup3
from strandline.functions.priority import TAG_TYPES

_TAG_BY_CODE = {c: n for n, c, _, _ in TAG_TYPES}
_CODE_BY_TAG = {n: c for n, c, _, _ in TAG_TYPES}
PAGE = 4096


class _In:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise FormatError("a file ends early")
        self.at += n
        return out

    def uint(self, n: int, order: str = "big") -> int:
        return int.from_bytes(self.take(n), order)

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise FormatError("a string has no end")
        out = self.data[self.at : end].decode("utf-8")
        self.at = end + 1
        return out


def _md5(data: bytes, n: int = 16) -> bytes:
    return hashlib.md5(data).digest()[:n]


# --- tags: one bit for each file, the first file highest -------------------------------------------------


def _read_tags(r: _In, tags: int, files: int) -> list[tuple[str, str, list[int]]]:
    out = []
    for _ in range(tags):
        name, code = r.text(), r.uint(2)
        if code not in _TAG_BY_CODE:
            raise FormatError(f"unknown tag type {code:#06x}")
        bits = np.unpackbits(np.frombuffer(r.take(-(-files // 8)), np.uint8))[:files]
        out.append((name, _TAG_BY_CODE[code], np.flatnonzero(bits).tolist()))
    return out


def _tag_bytes(tags: Iterable[tuple[str, str, list[int]]], files: int) -> bytes:
    out = []
    for name, kind, idx in tags:
        bits = np.zeros(-(-files // 8) * 8, np.uint8)
        bits[list(idx)] = 1
        out.append(name.encode() + b"\0" + struct.pack(">H", _CODE_BY_TAG[kind]) + np.packbits(bits).tobytes())
    return b"".join(out)


# --- install, download and size manifests ------------------------------------------------------------------


def parse_install(data: bytes) -> dict:
    """SRC-19, VAL-01."""
    r = _In(data)
    if r.take(2) != b"IN":
        raise FormatError("not an install manifest")
    version, width, tags, n = r.uint(1), r.uint(1), r.uint(2), r.uint(4)
    if version not in (1, 2) or width != 16:
        raise FormatError("an install manifest's header is broken")
    if version == 2:
        r.take(6)
    t = _read_tags(r, tags, n)
    files = []
    for i in range(n):
        path = r.text()
        files.append((i, path, r.take(16), r.uint(4), r.uint(1) if version == 2 else None))
    return {"version": version, "files": files, "tags": t}


def build_install(files: list[tuple], tags: list[tuple[str, str, list[int]]], version: int = 1) -> bytes:
    """SNK-07."""
    n = len(files)
    head = b"IN" + struct.pack(">BBHI", version, 16, len(tags), n) + (struct.pack(">BIB", 16, n, 0) if version == 2 else b"")
    body = b"".join(p.encode() + b"\0" + k + struct.pack(">I", s) + (bytes([kind or 0]) if version == 2 else b"") for _, p, k, s, kind in files)
    return head + _tag_bytes(tags, n) + body


def parse_download(data: bytes) -> dict:
    """SRC-20, VAL-02."""
    r = _In(data)
    if r.take(2) != b"DL":
        raise FormatError("not a download manifest")
    version, width, check, n, tags = r.uint(1), r.uint(1), r.uint(1), r.uint(4), r.uint(2)
    if version not in (1, 2, 3) or width != 16:
        raise FormatError("a download manifest's header is broken")
    flags = r.uint(1) if version >= 2 else 0
    base = struct.unpack("b", r.take(1))[0] if version >= 3 else 0
    if version >= 3:
        r.take(3)
    files = []
    for i in range(n):
        key, size, prio = r.take(16), r.uint(5), struct.unpack("b", r.take(1))[0]
        files.append((i, key, size, prio, r.uint(4) if check else None, r.take(flags) if flags else None))
    return {"version": version, "has_checksum": bool(check), "flag_size": flags, "base_priority": base, "files": files, "tags": _read_tags(r, tags, n)}


def build_download(files: list[tuple], tags: list[tuple[str, str, list[int]]], version: int = 1, has_checksum: bool = False, flag_size: int = 0, base_priority: int = 0) -> bytes:
    """SNK-08, VAL-19."""
    head = b"DL" + struct.pack(">BBBIH", version, 16, int(has_checksum), len(files), len(tags))
    head += (bytes([flag_size]) if version >= 2 else b"") + (struct.pack("b", base_priority) + bytes(3) if version >= 3 else b"")
    out = []
    for _, key, size, prio, check, flags in files:
        if has_checksum != (check is not None) or len(flags or b"") != flag_size or not 0 <= size < 1 << 40:
            raise FormatError("an entry does not fit the header")
        out.append(key + size.to_bytes(5, "big") + struct.pack("b", prio) + (struct.pack(">I", check) if has_checksum else b"") + (flags or b""))
    return head + b"".join(out) + _tag_bytes(tags, len(files))


def parse_size(data: bytes) -> dict:
    """SRC-21, AGG-34: the stated total must be the sum."""
    r = _In(data)
    if r.take(2) != b"DS":
        raise FormatError("not a size manifest")
    version, width, n, tags = r.uint(1), r.uint(1), r.uint(4), r.uint(2)
    if version == 1:
        total, w = r.uint(8), r.uint(1)
    elif version == 2:
        total, w = r.uint(5), 4
    else:
        raise FormatError("a size manifest's version is unknown")
    t = _read_tags(r, tags, n)
    files = [(i, r.take(width), r.uint(w)) for i in range(n)]
    if sum(f[2] for f in files) != total:
        raise FormatError("a size manifest's total is wrong")
    return {"version": version, "files": files, "tags": t}


def build_size(files: list[tuple], tags: list[tuple[str, str, list[int]]], version: int = 1, width: int = 9) -> bytes:
    """SNK-09, 42."""
    total = sum(f[2] for f in files)
    head = b"DS" + struct.pack(">BBIH", version, width, len(files), len(tags)) + (struct.pack(">QB", total, 4) if version == 1 else total.to_bytes(5, "big"))
    return head + _tag_bytes(tags, len(files)) + b"".join(k + struct.pack(">I", s) for _, k, s in files)


# --- the encoding table ---------------------------------------------------------------------------------------


def _pages(entries: list[tuple[bytes, bytes]], size: int) -> tuple[bytes, bytes, int]:
    """Sorted entries in zero-padded pages; the index of first keys and checksums; the number of pages."""
    pages, cur, first = [], b"", b""
    for key, raw in sorted(entries):
        if len(raw) > size:
            raise FormatError("an entry is larger than a page")
        if len(cur) + len(raw) > size:
            pages.append((first, cur.ljust(size, b"\0")))
            cur = b""
        first = first if cur else key
        cur += raw
    if cur:
        pages.append((first, cur.ljust(size, b"\0")))
    return b"".join(f.ljust(16, b"\0") + _md5(p) for f, p in pages), b"".join(p for _, p in pages), len(pages)


def parse_encoding(data: bytes) -> dict:
    """SRC-16..18; VAL-03; SCL-14: pages are checked against their MD5. A chunk container is unpacked first."""
    if data[:4] == MAGIC:
        data = read_container(data)
    r = _In(data)
    if r.take(2) != b"EN":
        raise FormatError("not an encoding table")
    version, hc, he, kc, ke, nc, ne, flags, nspec = r.uint(1), r.uint(1), r.uint(1), r.uint(2), r.uint(2), r.uint(4), r.uint(4), r.uint(1), r.uint(4)
    if version != 1 or hc != 16 or he != 16 or not kc or not ke or flags:
        raise FormatError("an encoding table's header is broken")
    raw = r.take(nspec)
    if raw and not raw.endswith(b"\0"):
        raise FormatError("the spec block has no end")
    specs = [s.decode() for s in raw.split(b"\0")[:-1]]
    if "" in specs:
        raise FormatError("an empty spec")
    out: dict = {"specs": list(enumerate(specs)), "ckeys": [], "ekeys": []}
    for name, count, kb in (("ckeys", nc, kc), ("ekeys", ne, ke)):
        index = [(r.take(16), r.take(16)) for _ in range(count)]
        for page, (_, digest) in enumerate(index):
            body = r.take(kb * 1024)
            if _md5(body) != digest:
                raise FormatError("a page is damaged")
            p, pos = _In(body), 0
            while p.at < len(body):
                if name == "ckeys":
                    n = body[p.at]
                    if n == 0:
                        break
                    p.at += 1
                    size, key = p.uint(5), p.take(16)
                    out[name].append((page, pos, key, size, [p.take(16) for _ in range(n)]))
                else:
                    if len(body) - p.at < 25:
                        break
                    key, spec, size = p.take(16), p.uint(4), p.uint(5)
                    if spec == 0xFFFFFFFF or key == bytes(16):
                        break
                    out[name].append((page, pos, key, spec, size))
                pos += 1
    out["trailing"] = data[r.at :].decode("utf-8", "replace") or None
    return out


def build_encoding(ckeys: list[tuple], ekeys: list[tuple], specs: list[str], trailing: str = "", kb: int = 4) -> bytes:
    """SNK-06, 29: entries (key, size, ekeys) and (key, spec, size)."""
    c = [(k, bytes([len(e)]) + s.to_bytes(5, "big") + k + b"".join(e)) for k, s, e in ckeys]
    e = [(k, k + struct.pack(">I", sp) + s.to_bytes(5, "big")) for k, sp, s in ekeys]
    ci, cp, nc = _pages(c, kb * 1024)
    ei, ep, ne = _pages(e, kb * 1024)
    block = b"".join(s.encode() + b"\0" for s in specs)
    return b"EN" + struct.pack(">BBBHHIIBI", 1, 16, 16, kb, kb, nc, ne, 0, len(block)) + block + ci + cp + ei + ep + trailing.encode()


# --- the root table ----------------------------------------------------------------------------------------------

NO_NAME_HASH = 0x10000000


def _header(order: str, *values: int) -> bytes:
    return b"".join(v.to_bytes(4, order) for v in values)


def parse_root(data: bytes) -> list[tuple]:
    """SRC-14, 15; WIN-14: (version, block, pos, fdid, ckey, name_hash, locale, content)."""
    r, version = _In(data), 1
    if data[:4] in (b"MFST", b"TSFM"):
        order = "big" if data[:4] == b"MFST" else "little"
        r.at = 4
        a, b = r.uint(4, order), r.uint(4, order)
        if 16 <= a < 100 and 1 <= b <= 4:
            version, r.at = max(2, b), a
        else:
            version, r.at = 2, 12
    rows, block = [], 0
    while r.at < len(data):
        try:
            n = r.uint(4, "little")
            if version == 1:
                content, locale = r.uint(4, "little"), r.uint(4, "little")
            elif version < 4:
                locale, f1, f2, f3 = r.uint(4, "little"), r.uint(4, "little"), r.uint(4, "little"), r.uint(1)
                content = f1 | f2 | f3 << 17
            else:
                locale, f1, f2, f3 = r.uint(4, "little"), r.uint(4, "little"), r.uint(4, "little"), r.uint(2, "little")
                content = f1 | f2 | f3 << 17
            if n == 0 or n > 1_000_000:
                block += 1
                continue
            ids = np.cumsum(np.frombuffer(r.take(4 * n), "<u4").astype(np.int64)) + np.arange(n)
            ids &= 0xFFFFFFFF
            if version == 1:
                raw = np.frombuffer(r.take(24 * n), np.uint8).reshape(n, 24)
                keys, names = raw[:, :16], raw[:, 16:].copy().view("<i8")[:, 0].tolist()
            else:
                keys = np.frombuffer(r.take(16 * n), np.uint8).reshape(n, 16)
                names = [None] * n if content & NO_NAME_HASH else np.frombuffer(r.take(8 * n), "<i8").tolist()
        except FormatError:
            break  # a broken later block ends the scan
        rows += [(version, block, i, int(ids[i]), keys[i].tobytes(), names[i], locale, content) for i in range(n)]
        block += 1
    return rows


def build_root(rows: list[tuple], version: int = 1) -> bytes:
    """SNK-05, 31: rows (fdid, ckey, name_hash, locale, content), grouped by flags and sorted by id."""
    groups: dict[tuple[int, int], list] = {}
    for row in rows:
        groups.setdefault((row[3], row[4]), []).append(row)
    out = []
    for (locale, content), g in sorted(groups.items()):
        g.sort(key=lambda x: x[0])
        ids = [x[0] for x in g]
        if len(set(ids)) != len(ids):
            raise FormatError("an id repeats within a block")
        deltas = b"".join(struct.pack("<I", i - p - 1) for p, i in zip([-1, *ids[:-1]], ids, strict=True))
        if version == 1:
            out.append(struct.pack("<III", len(g), content, locale) + deltas + b"".join(x[1] + struct.pack("<q", x[2] or 0) for x in g))
        else:
            tail = struct.pack("<IIB", content & 0x1FFFF | content & ~0x1FFFF & 0xFFFFFFFF, 0, 0) if version < 4 else struct.pack("<IIH", content & 0xFFFFFFFF, 0, content >> 32 << 15 & 0xFFFF)
            names = b"" if content & NO_NAME_HASH else b"".join(struct.pack("<q", x[2] or 0) for x in g)
            out.append(struct.pack("<II", len(g), locale) + tail + deltas + b"".join(x[1] for x in g) + names)
    n, named = len(rows), sum(r[2] is not None for r in rows)
    head = b"" if version == 1 else b"TSFM" + (_header("little", n, named) if version == 2 else _header("little", 24, version, n, named, 0))
    return head + b"".join(out)


# --- archive indexes and groups ------------------------------------------------------------------------------


def parse_index(data: bytes, verify: bool = True) -> list[tuple]:
    """SRC-22, 24; VAL-04, 16, 17; SCL-13: (pos, ekey, size, offset, archive_index); six-byte offsets hold an archive number."""
    if len(data) < 28:
        raise FormatError("not an index")
    hash_bytes = data[-13]
    foot = data[-(20 + hash_bytes) :]
    version, kb, w_off, w_size, w_key = foot[8], foot[11], foot[12], foot[13], foot[14]
    (count,) = struct.unpack_from("<I", foot, 16)
    if version > 1 or kb != 4 or w_off not in (4, 5, 6) or w_size != 4 or not 9 <= w_key <= 16:
        raise FormatError("an index's footer is broken")
    if verify and _md5(foot[8:20].ljust(20, b"\0"), hash_bytes) != foot[20:]:
        raise FormatError("an index's footer is damaged")
    width = w_key + w_size + w_off
    per = PAGE // width
    pages = -(-count // per)
    if len(data) != pages * (PAGE + w_key + hash_bytes) + 20 + hash_bytes:
        raise FormatError("an index has another size than its footer says")
    out = []
    for p in range(pages):
        for i in range(per):
            at = p * PAGE + i * width
            raw = data[at : at + width]
            if not any(raw):
                break
            off = int.from_bytes(raw[w_key + w_size :], "big")
            out.append((len(out), raw[:w_key], int.from_bytes(raw[w_key : w_key + w_size], "big"), off & 0xFFFFFFFF if w_off == 6 else off, off >> 32 if w_off == 6 else None))
    if len(out) != count or any(a[1] > b[1] for a, b in zip(out, out[1:], strict=False)):
        raise FormatError("an index is not sorted or has another count")
    return out


def build_index(rows: list[tuple], group: bool = False, width: int = 16) -> bytes:
    """SNK-10, 11, 30; SCL-11, 12: rows (ekey, size, offset, archive_index), sorted by key, in pages with a table of last keys."""
    recs = [k + struct.pack(">I", s) + ((a << 32 | o).to_bytes(6, "big") if group else struct.pack(">I", o)) for k, s, o, a in sorted(rows, key=lambda r: r[0])]
    per = PAGE // (len(recs[0]) if recs else 1)
    pages = [b"".join(recs[i : i + per]).ljust(PAGE, b"\0") for i in range(0, len(recs), per)]
    last = [recs[min(i + per, len(recs)) - 1][:width] for i in range(0, len(recs), per)]
    toc = b"".join(last) + b"".join(_md5(p, 8) for p in pages)
    foot = bytes([1, 0, 0, 4, 6 if group else 4, 4, width, 8]) + struct.pack("<I", len(recs))
    return b"".join(pages) + toc + _md5(toc, 8) + foot + _md5(foot.ljust(20, b"\0"), 8)


# --- the local index, its log, and residency ---------------------------------------------------------------

STATUS = {0: "Normal", 3: "Delete", 6: "HeaderNonResident", 7: "DataNonResident"}
_STATUS_CODE = {v: k for k, v in STATUS.items()}


def _location(archive: int, offset: int) -> bytes:
    return (archive << 30 | offset).to_bytes(5, "big")


def parse_log(data: bytes) -> list[tuple]:
    """SRC-37, VAL-14: (seq, ekey9, archive, offset, size, status) of 512-byte pages of 21 records.

    A record without a guard ends its page, an all-zero page the log; a wrong guard is an error.
    """
    raws = []
    for p in range(0, len(data) - 511, 512):
        if not any(data[p : p + 512]):
            break
        for i in range(21):
            raw = data[p + 24 * i : p + 24 * i + 24]
            if not any(raw[:4]):
                break
            raws.append(raw)
    guards = lookup3([r[4:23] for r in raws])[0] | np.uint32(0x80000000) if raws else []
    out = []
    for raw, guard in zip(raws, guards, strict=True):
        if struct.unpack_from("<I", raw)[0] != int(guard):
            raise FormatError("a log record is damaged")
        loc = int.from_bytes(raw[13:18], "big")
        out.append((len(out), raw[4:13], loc >> 30, loc & 0x3FFFFFFF, struct.unpack_from("<I", raw, 18)[0], STATUS.get(raw[22], str(raw[22]))))
    return out


def build_log(rows: list[tuple]) -> bytes:
    """SNK-19: rows (ekey9, archive, offset, size, status)."""
    bodies = [k + _location(a, o) + struct.pack("<I", s) + bytes([_STATUS_CODE[st], 0]) for k, a, o, s, st in rows]
    guards = lookup3([b[:19] for b in bodies])[0] | np.uint32(0x80000000) if bodies else []
    recs = [struct.pack("<I", int(g)) + b for g, b in zip(guards, bodies, strict=True)]
    return b"".join(b"".join(recs[i : i + 21]).ljust(512, b"\0") for i in range(0, len(recs), 21))


def parse_local_records(data: bytes) -> list[tuple]:
    """SRC-36: (pos, ekey9, archive, offset, size) of 18-byte records."""
    out = []
    for i in range(0, len(data) - 17, 18):
        loc = int.from_bytes(data[i + 9 : i + 14], "big")
        out.append((i // 18, data[i : i + 9], loc >> 30, loc & 0x3FFFFFFF, struct.unpack_from("<I", data, i + 14)[0]))
    return out


def build_local_records(rows: list[tuple]) -> bytes:
    """SNK-18: rows (ekey9, archive, offset, size), sorted by key."""
    return b"".join(k + _location(a, o) + struct.pack("<I", s) for k, a, o, s in sorted(rows))


# --- the patch index --------------------------------------------------------------------------------------------


def parse_patch_entries(data: bytes, key_size: int = 16) -> list[tuple]:
    """SRC-27, 55, 56: (pos, source, source_size, target, target_size, encoded_size, suffix, patch) of fixed records."""
    width, out = 3 * key_size + 13, []
    if len(data) % width:
        raise FormatError("a patch block is cut off")
    for i in range(0, len(data), width):
        r = _In(data, i)
        out.append((i // width, r.take(key_size), r.uint(4, "little"), r.take(key_size), r.uint(4, "little"), r.uint(4, "little"), r.uint(1), r.take(key_size)))
    return out


def build_patch_entries(rows: list[tuple]) -> bytes:
    """SNK-14: rows without their position."""
    return b"".join(s + struct.pack("<I", ss) + t + struct.pack("<II", ts, es) + bytes([x]) + p for s, ss, t, ts, es, x, p in rows)


# --- Spark -------------------------------------------------------------------------------------------------------

_I, _L, _S, _B = T.IntegerType(), T.LongType(), T.StringType(), T.BinaryType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _tag_rows(parsed: dict) -> list[tuple]:
    return [(t, kind, p, i) for p, (t, kind, idx) in enumerate(parsed["tags"]) for i in idx]


FORMATS: dict[str, tuple[T.StructType, Callable[[bytes], list[tuple]]]] = {
    "install_files": (_schema(idx=_I, path=_S, ckey=_B, file_size=_L, file_type=_I), lambda b: parse_install(b)["files"]),
    "install_tags": (_schema(tag=_S, tag_type=_S, tag_pos=_I, idx=_I), lambda b: _tag_rows(parse_install(b))),
    "download_files": (_schema(idx=_I, ekey=_B, file_size=_L, priority=_I, checksum=_L, flags=_B), lambda b: parse_download(b)["files"]),
    "download_tags": (_schema(tag=_S, tag_type=_S, tag_pos=_I, idx=_I), lambda b: _tag_rows(parse_download(b))),
    "size_entries": (_schema(idx=_I, ekey=_B, esize=_L), lambda b: parse_size(b)["files"]),
    "enc_ckey": (_schema(page=_I, pos=_I, ckey=_B, file_size=_L, ekeys=T.ArrayType(_B)), lambda b: parse_encoding(b)["ckeys"]),
    "enc_ekey": (_schema(page=_I, pos=_I, ekey=_B, espec_index=_L, file_size=_L), lambda b: parse_encoding(b)["ekeys"]),
    "espec": (_schema(idx=_I, spec=_S), lambda b: parse_encoding(b)["specs"]),
    "root": (_schema(version=_I, block=_I, pos=_I, fdid=_L, ckey=_B, name_hash=_L, locale_flags=_L, content_flags=_L), parse_root),
    "cdn_index": (_schema(pos=_I, ekey=_B, size=_L, offset=_L, archive_index=_I), parse_index),
    "idx_log": (_schema(seq=_L, ekey9=_B, archive_id=_I, offset=_L, size=_L, status=_S), parse_log),
    "idx_base": (_schema(pos=_L, ekey9=_B, archive_id=_I, offset=_L, size=_L), parse_local_records),
    "patch_index": (_schema(pos=_L, source_ekey=_B, source_size=_L, target_ekey=_B, target_size=_L, encoded_size=_L, suffix_offset=_I, patch_ekey=_B), parse_patch_entries),
}


def rows(blobs: DataFrame, kind: str) -> DataFrame:
    """Rows of a format's blobs (doc, content), with ``doc``; a broken blob stops the query."""
    import pyarrow as pa

    schema, parse = FORMATS[kind]
    full = T.StructType([blobs.schema["doc"], *schema.fields])
    arrow = to_arrow_schema(full)

    def run(batches):
        for b in batches:
            for doc, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = parse(blob)
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    cols = list(zip(*part, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(part), arrow.field(0).type), *[pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True)]], schema=arrow)

    return blobs.select("doc", "content").mapInArrow(run, full)


def read(spark: SparkSession, kind: str, path: str, glob: str = "*") -> DataFrame:
    """Rows of all files of a format, with ``doc``; a broken file stops the query."""
    return rows(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("doc"), "content"), kind)


def build_groups(df: DataFrame, by: list[str], order: list[str], build: Callable[[list[dict]], bytes]) -> DataFrame:
    """One blob for each group of rows, in order: (keys, content). A group is one file of its format."""
    import pyarrow as pa

    out = T.StructType([*[df.schema[k] for k in by], T.StructField("content", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([(o, "ascending") for o in order]).to_pylist()
        return pa.Table.from_pylist([{**{k: rows[0][k] for k in by}, "content": build(rows)}], schema=arrow)

    return df.groupBy(*by).applyInArrow(run, out)


def read_slices(blobs: DataFrame, requests: DataFrame, doc: str = "doc") -> DataFrame:
    """SRC-25, 39, 40, 51..53, 64: the bytes of requests (doc, offset, size) out of whole blobs (doc, content)."""
    return requests.join(blobs.select(doc, "content"), doc).select(*requests.columns, F.substring("content", F.col("offset").cast("int") + 1, F.col("size").cast("int")).alias("data"))


def read_ranges(requests: DataFrame, path: str = "path", offset: str = "offset", size: str = "size") -> DataFrame:
    """SRC-25, 39, 40, 51..53, 64 for archives of any size: the task opens each file and reads the asked ranges only.

    Requests come file by file in the order of their offsets. ``path`` is a file on a folder that the executors
    have mounted; a range beyond the file's end gives the bytes that are there.
    """
    import pyarrow as pa

    schema = T.StructType([*requests.schema.fields, T.StructField("data", T.BinaryType())])
    at = [requests.columns.index(c) for c in (path, offset, size)]
    arrow = to_arrow_schema(schema)

    def run(batches):
        name, f = None, None
        try:
            for b in batches:
                data = []
                for p, o, n in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                    if p != name:
                        if f:
                            f.close()
                        name, f = p, open(p.removeprefix("file://").removeprefix("file:"), "rb")
                    f.seek(o)
                    data.append(f.read(n))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], schema=arrow)
        finally:
            if f:
                f.close()

    dealt = requests.repartition(path, F.floor(F.col(offset) / (1 << 28))).sortWithinPartitions(path, offset)
    return dealt.mapInArrow(run, schema)


class PagedIndex(DataSource):
    """SRC-23: ``spark.read.format("pagedindex").load(path)``: an index read page by page.

    The footer and the table of last keys are read at planning. A partition is a run of pages; with
    ``spark.sql.python.filterPushdown.enabled``, an equality on ``ekey`` leaves the one page that may hold it.
    """

    @classmethod
    def name(cls) -> str:
        return "pagedindex"

    def schema(self) -> T.StructType:
        return FORMATS["cdn_index"][0]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options["path"].removeprefix("file://").removeprefix("file:"))


class _Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _PagedReader(DataSourceReader):
    RUN = 256

    def __init__(self, path: str):
        self.path, self.keys = path, None
        with open(path, "rb") as f:
            size = f.seek(0, 2)
            f.seek(max(0, size - 28))
            foot = f.read()
            if len(foot) < 28 or foot[-13] != 8 or foot[11] != 4 or foot[13] != 4:
                raise FormatError("not an index")
            self.w_off, self.w_key = foot[12], foot[14]
            (self.count,) = struct.unpack_from("<I", foot, 16)
            self.width = self.w_key + 4 + self.w_off
            self.per = PAGE // self.width
            pages = -(-self.count // self.per)
            f.seek(pages * PAGE)
            raw = f.read(pages * self.w_key)
            self.last = [raw[i : i + self.w_key] for i in range(0, len(raw), self.w_key)]

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ekey",) and isinstance(f.value, (bytes, bytearray)):
                self.keys = [bytes(f.value)]
            yield f  # checked again on the rows

    def partitions(self):
        if self.keys is not None:
            at = sorted({bisect.bisect_left(self.last, k) for k in self.keys})
            return [_Pages(p, p + 1) for p in at if p < len(self.last)] or [_Pages(0, 0)]
        return [_Pages(p, min(p + self.RUN, len(self.last))) for p in range(0, len(self.last), self.RUN)] or [_Pages(0, 0)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            f.seek(partition.first * PAGE)
            for p in range(partition.first, partition.last):
                page = f.read(PAGE)
                for i in range(self.per):
                    raw = page[i * self.width : (i + 1) * self.width]
                    if not any(raw):
                        break
                    off = int.from_bytes(raw[self.w_key + 4 :], "big")
                    group = self.w_off == 6
                    yield p * self.per + i, raw[: self.w_key], int.from_bytes(raw[self.w_key : self.w_key + 4], "big"), off & 0xFFFFFFFF if group else off, off >> 32 if group else None
