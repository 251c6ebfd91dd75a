"""Extension points and the checks around them.

Caches and HTTP clients as interfaces (EXT-04, EXT-06) have no data semantics here: Spark's own cache and readers
take their place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Container(Protocol):
    """EXT-02: something with content by key, as frames (key, location) and (location, bytes)."""

    def index(self, spark: SparkSession) -> DataFrame: ...

    def blobs(self, spark: SparkSession) -> DataFrame: ...


#: EXT-05: hooks that judge content: name -> (content, key) -> boolean Column.
HOOKS: dict[str, Callable[[Column, Column], Column]] = {
    "md5": lambda data, key: F.md5(data) == F.lower(F.hex(key)),
    "not_empty": lambda data, key: F.octet_length(data) > 0,
}


def register_hook(name: str, hook: Callable[[Column, Column], Column]) -> None:
    """EXT-05."""
    HOOKS[name] = hook


def validate_with(df: DataFrame, hooks: list[str], data: str = "content", key: str = "key") -> DataFrame:
    """EXT-05, 09: the rows with an array of the hooks that they fail."""
    failed = [F.when(~F.coalesce(HOOKS[h](F.col(data), F.col(key)), F.lit(False)), F.lit(h)) for h in hooks]
    return df.withColumn("failed", F.array_compact(F.array(*failed)))


def register_format(name: str, schema: T.StructType, parse: Callable[[bytes], list[tuple]]) -> None:
    """EXT-01: a binary format of one's own for ``sources.binary.read``."""
    from strandline.sources.binary import FORMATS

    FORMATS[name] = (schema, parse)


def round_trip(data: bytes, parse: Callable, build: Callable) -> bool:
    """EXT-08, VAL-13: does building what was parsed give the same bytes?"""
    return build(parse(data)) == data


def with_keys(chunks: DataFrame, keys: DataFrame, limit: int = 100_000) -> Mapping[int, bytes]:
    """EXT-03: the keys that a table of chunks needs, from any frame (key_id, key_value in hex).

    Only keys that the chunks name are fetched, ``limit`` at most, so the map stays small whatever the key list.
    """
    wanted = chunks.select(F.lower("key_id").alias("key_id")).distinct()
    rows = keys.select(F.lower("key_id").alias("key_id"), "key_value").join(wanted, "key_id", "left_semi").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("more keys than a task should hold")
    return {int(r["key_id"], 16): bytes.fromhex(r["key_value"]) for r in rows}


def row_map(names: list[str]) -> Column:
    """PRJ-12, 13: a row as a map from name to text."""
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])


def must_invalidate(expires: Column, now: Column, entries: Column, most_entries: int, size: Column, most_bytes: int) -> Column:
    """FLT-40: any of time, number and memory."""
    return F.coalesce(expires <= now, F.lit(False)) | (entries > most_entries) | (size > most_bytes)


def is_zero(key: Column, size: Column, offset: Column) -> Column:
    """FLT-46: an all-zero record."""
    return F.hex(key).rlike("^0*$") & (size == 0) & (offset == 0)


def promote(rule: str, hits: Column, age_seconds: Column, n: int = 3, per_minute: float = 1.0, oldest: int = 300) -> Column:
    """FLT-57: on a hit, after n hits, by frequency, by age, or never by itself."""
    return {
        "on_hit": hits >= 1,
        "after": hits >= n,
        "frequency": F.when(age_seconds > 0, hits * 60.0 / age_seconds >= per_minute).otherwise(hits >= 1),
        "age": (hits >= 1) & (age_seconds <= oldest),
        "manual": F.lit(False),
    }[rule]


def needs_compaction(used: Column, size: Column, threshold: float = 0.7) -> Column:
    """FLT-58: less used than the threshold and larger than 1 MiB; never when nothing is used."""
    return (used > 0) & (size > 1 << 20) & (used < size * threshold)


def read_resident(index: DataFrame, blobs: DataFrame, key: str = "key") -> DataFrame:
    """SRC-62: content by index; ``resident`` is false where the blob ends before the entry does."""
    from strandline.sources.binary import read_slices

    got = read_slices(blobs, index)
    return got.withColumn("resident", F.octet_length("data") == F.col("size"))


def chunk_range(chunks: DataFrame, first: int, count: int) -> DataFrame:
    """SRC-65: a run of chunks by number."""
    return chunks.where((F.col("idx") >= first) & (F.col("idx") < first + count))


def varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """SCL-41: a number of seven bits a byte, the lowest first, and where it ends."""
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if not b & 128:
            return n, at
        if shift > 63:
            raise ValueError("a number is too long")


def gauges(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """STR-19: metrics of each batch, for a ``StreamingQueryListener`` or an ``Observation``."""
    return df.observe(name, *[c.alias(k) for k, c in metrics.items()])
