"""Content keys, buckets, checksums and typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_key(data: Column) -> Column:
    """SCL-04, SCL-34: the MD5 of the content, as sixteen bytes."""
    return F.unhex(F.md5(data))


def key_from_hex(text: Column) -> Column:
    """SCL-05: sixteen bytes from 32 hex digits; null for anything else."""
    return F.when(text.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(text))


def key_to_hex(key: Column) -> Column:
    return F.lower(F.hex(key))


def short_key(key: Column, n: int = 9) -> Column:
    """SCL-06: the first bytes of a key."""
    return F.substring(key, 1, n)


def _fold(key: Column, n: int) -> Column:
    """XOR of the first n bytes of a binary key, by bytes."""
    h = F.hex(key)
    out = F.lit(0)
    for i in range(n):
        out = out.bitwiseXOR(F.coalesce(F.conv(F.nullif(F.substring(h, 2 * i + 1, 2), F.lit("")), 16, 10).cast("int"), F.lit(0)))
    return out


def bucket(key: Column) -> Column:
    """SCL-07: bucket 0..15 of a key by its first nine bytes; 0 for shorter keys, null for null."""
    x = _fold(key, 9)
    return F.when(key.isNull(), F.lit(None).cast("int")).when(F.octet_length(key) < 9, F.lit(0)).otherwise(x.bitwiseAND(15).bitwiseXOR(F.shiftright(x, 4)))


def bucket_seeded(key: Column, seed: int) -> Column:
    """SCL-08: as SCL-07 with a seed added, modulo 16."""
    x = _fold(key, 9)
    return F.shiftright(x, 4).bitwiseXOR(x).__add__(seed).bitwiseAND(15)


def residency_bucket(key: Column) -> Column:
    """SCL-09: all sixteen bytes."""
    x = _fold(key, 16)
    return F.shiftright(x, 4).bitwiseXOR(x).bitwiseAND(15)


def archive_number(key: Column) -> Column:
    """SET-03: archive number by the key's hash."""
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int")


def block_hash(page: Column, n: int = 8) -> Column:
    """SCL-11, 12, 13: the first bytes of the MD5 of a page, of concatenated keys and hashes, or of a footer."""
    return F.substring(F.unhex(F.md5(page)), 1, n)


def matches_md5(data: Column, digest: Column) -> Column:
    """SCL-14, 15, 28; VAL-10, 11, 23: does the content have this MD5 (binary)?"""
    return F.coalesce(F.md5(data) == F.lower(F.hex(digest)), F.lit(False))


def uint_be(data: Column) -> Column:
    """SCL-17: big-endian unsigned integer of up to seven bytes."""
    return F.conv(F.hex(data), 16, 10).cast("long")


def uint_le(data: Column) -> Column:
    """Little-endian unsigned integer of up to seven bytes."""
    h = F.hex(data)
    pairs = F.transform(F.sequence(F.octet_length(data), F.lit(1), F.lit(-1)), lambda i: F.substring(h, i * 2 - 1, F.lit(2)))
    return F.conv(F.array_join(pairs, ""), 16, 10).cast("long")


def typed_value(raw: Column, kind: str) -> Column:
    """SCL-18: STRING, HEX or DEC field; an empty one is null, a malformed one raises in ``typed_value_strict``, here it is null."""
    full = F.nullif(raw, F.lit(""))
    if kind == "STRING":
        return full
    if kind == "HEX":
        return F.when(full.rlike("^([0-9A-Fa-f]{2})+$"), F.unhex(full))
    if kind == "DEC":
        return F.when(full.rlike(r"^[+-]?[0-9]+$"), full.try_cast("bigint"))
    raise ValueError(f"unknown field type {kind!r}")


def typed_value_strict(raw: Column, kind: str) -> Column:
    """SCL-18 with the error: a field that is neither empty nor well formed stops the query."""
    v = typed_value(raw, kind)
    bad = (F.nullif(raw, F.lit("")).isNotNull()) & v.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"not a {kind} value: "), raw))).otherwise(v)


def find_bytes(content: Column, needle: bytes) -> Column:
    """SCL-33: first 0-based position of a byte string, null if absent."""
    hits = find_all_bytes(content, needle)
    return F.when(F.size(hits) > 0, hits[0])


def find_all_bytes(content: Column, needle: bytes) -> Column:
    """STR-13: all 0-based positions, overlapping ones too; an empty array if absent."""
    n = len(needle)
    last = F.octet_length(content) - n + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(at, lambda p: F.substring(content, p, F.lit(n)) == F.lit(needle)), lambda p: p - 1)
