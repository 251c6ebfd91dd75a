"""Path, URL and cache-key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """PRJ-08: what follows the last slash or backslash."""
    return F.regexp_extract(path, r"[^\\/]*$", 0)


def directory(path: Column) -> Column:
    """PRJ-09: what precedes the last separator; null if there is none."""
    return F.when(path.rlike(r"[\\/]"), F.regexp_extract(path, r"(?s)^(.*)[\\/][^\\/]*$", 1))


def extension(path: Column) -> Column:
    """PRJ-10: after the last dot of the file name; null without a dot, empty after a trailing one."""
    name = file_name(path)
    return F.when(name.contains("."), F.regexp_extract(name, r"\.([^.]*)$", 1))


def normalized(path: Column) -> Column:
    """PRJ-11: with forward slashes."""
    return F.translate(path, "\\", "/")


def content_path(key_hex: Column) -> Column:
    """PRJ-19: ``ab/cd/rest`` of a hex key."""
    return F.concat_ws("/", F.substring(key_hex, 1, 2), F.substring(key_hex, 3, 2), F.substring(key_hex, 5, 1000))


def hash_directories(digest: Column) -> Column:
    """PRJ-21: struct of the two leading directory names, lower case; null when shorter than four characters."""
    d = F.lower(digest)
    return F.when(F.length(d) >= 4, F.struct(F.substring(d, 1, 2).alias("first"), F.substring(d, 3, 2).alias("second")))


def delivery_url(host: Column, base: Column, kind: Column, digest: Column, scheme: str = "http") -> Column:
    """PRJ-20 and PRJ-30: ``scheme://host/base/kind/ab/cd/digest``; null for a digest that is too short."""
    dirs = hash_directories(digest)
    return F.when(dirs.isNotNull(), F.concat_ws("/", F.concat(F.lit(f"{scheme}://"), host), F.regexp_replace(base, "^/+|/+$", ""), kind, dirs["first"], dirs["second"], F.lower(digest)))


def cache_key(kind: str, *parts: Column) -> Column:
    """PRJ-24: parts joined by colons after the kind; null parts are left out."""
    return F.concat_ws(":", F.lit(kind), *parts)


def matches_pattern(path: Column, pattern: str) -> Column:
    """FLT-10: case-insensitive. ``a*b`` is prefix and suffix, which may overlap; ``*x*`` contains; else literal contains."""
    p = pattern.lower()
    low = F.lower(path)
    if p.count("*") == 1:
        head, tail = p.split("*")
        return low.startswith(head) & low.endswith(tail)
    if p.count("*") == 2 and len(p) > 1 and p[0] == p[-1] == "*":
        return low.contains(p[1:-1])
    return low.contains(p)


def has_extension(path: Column, wanted: str) -> Column:
    """FLT-12: extension equal but for case; false without one."""
    return F.coalesce(F.lower(extension(path)) == wanted.lower(), F.lit(False))


def valid_endpoint(text: Column) -> Column:
    """FLT-54: 1 to 1000 characters, letters, digits and ``/ _ - .``."""
    return F.coalesce(F.length(text).between(1, 1000) & text.rlike(r"^[\p{L}\p{N}/_\-.]+$"), F.lit(False))


def data_file_segment(name: Column) -> Column:
    """SCL-38: segment of ``data.NNN`` or ``data.NNNN``, below 1023; else null."""
    n = F.try_to_number(F.nullif(F.regexp_extract(name, r"^data\.([0-9]{3,4})$", 1), F.lit("")), F.lit("9999")).cast("int")
    return F.when(n < 1023, n)


def generation_name(generation: Column, suffix: str = ".lru") -> Column:
    """SCL-39: sixteen lower-case hex digits and a suffix."""
    return F.concat(F.lower(F.lpad(F.hex(generation), 16, "0")), F.lit(suffix))


def name_generation(name: Column, suffix: str = ".lru") -> Column:
    """SCL-39 backward; null for other names."""
    digits = F.regexp_extract(name, rf"^([0-9a-f]{{16}}){suffix.replace('.', '[.]')}$", 1)
    return F.when(digits != "", F.conv(digits, 16, -10).cast("long"))


def endpoint_ttl(endpoint: Column, rules: list[tuple[str, int]], default: int) -> Column:
    """SCL-42: seconds to keep a response, by the first text that its endpoint contains."""
    out = F.lit(default)
    for part, seconds in reversed(rules):
        out = F.when(endpoint.contains(part), F.lit(seconds)).otherwise(out)
    return out
