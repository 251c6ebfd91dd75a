"""Byte ranges with inclusive ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(start: Column, end: Column) -> Column:
    return end - start + 1


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def adjacent(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_end + 1 == b_start) | (b_end + 1 == a_start)


def gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """SCL-32: bytes between two ranges, 0 if they touch or overlap."""
    return F.greatest(F.lit(0).cast("long"), F.greatest(a_start, b_start) - F.least(a_end, b_end) - 1)


def merged(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """SET-23: the range that holds both."""
    return F.struct(F.least(a_start, b_start).alias("start"), F.greatest(a_end, b_end).alias("end"))


def split(start: Column, end: Column, size: int) -> Column:
    """SET-24: array of ranges of at most ``size`` bytes."""
    return F.transform(F.sequence(start, end, F.lit(size).cast("long")), lambda s: F.struct(s.alias("start"), F.least(s + (size - 1), end).alias("end")))


def inside(start: Column, end: Column, content_length: Column) -> Column:
    """VAL-15: a range that starts at or before its end and ends within the content."""
    return (start <= end) & (end < content_length)


def content_range_ok(header: Column, start: Column, size: Column) -> Column:
    """SCL-43: does ``bytes a-b/total`` answer the request for ``size`` bytes from ``start``?"""
    a = F.regexp_extract(header, r"^bytes (\d+)-(\d+)/(?:\d+|\*)$", 1).try_cast("bigint")
    b = F.regexp_extract(header, r"^bytes (\d+)-(\d+)/(?:\d+|\*)$", 2).try_cast("bigint")
    return F.coalesce((a == start) & (b == start + size - 1), F.lit(False))


def header_value(ranges: Column) -> Column:
    """PRJ-29: ``bytes=a-b, c-d`` of an array of ranges."""
    return F.concat(F.lit("bytes="), F.array_join(F.transform(ranges, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ", "))


def retry_delay(attempt: Column, base_ms: float, most_ms: float, condition: Column) -> Column:
    """SCL-36 without jitter: 0 before the first retry, else doubling, capped, scaled by the network's condition."""
    scale = F.when(condition == "Excellent", 0.5).when(condition == "Good", 0.8).when(condition == "Fair", 1.0).when(condition == "Poor", 1.5).otherwise(2.0)
    return F.when(attempt <= 0, F.lit(0.0)).otherwise(F.least(F.lit(most_ms), F.pow(F.lit(2.0), attempt - 1) * base_ms) * scale)
