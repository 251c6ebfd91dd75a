"""Aggregations. Empty inputs give the figures the survey states, not nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import priority as P


def total(c: str) -> Column:
    """AGG-01, 23: a sum that is 0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def ratio(num: Column, den: Column, empty: float) -> Column:
    """AGG-09, 10, 46, 51..54, 57, 63: a ratio with a fixed value for a zero denominator."""
    return F.when(den == 0, F.lit(empty)).otherwise(num.cast("double") / den)


def install_stats(files: DataFrame, bridge: DataFrame) -> DataFrame:
    """AGG-01, 03, 04: files, tags, bytes, and the largest number of files in one tag."""
    a = files.agg(F.count("*").alias("total_files"), total("file_size").alias("total_size"))
    per = bridge.groupBy("tag").agg(F.countDistinct("idx").alias("n"))
    b = per.agg(F.count("*").alias("total_tags"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("tagged_files"))
    return a.crossJoin(b)  # one row each


def tag_counts(bridge: DataFrame, by: Sequence[str] = ("tag",)) -> DataFrame:
    """AGG-04, 32: distinct files per tag."""
    return bridge.groupBy(*by).agg(F.countDistinct("idx").alias("n_files"))


def tag_analysis(tags: DataFrame) -> DataFrame:
    """AGG-25, 26; FLT-30, 31: how many tags each class holds; classes overlap."""
    names = ("platform_specific", "locale_specific", "optional", "required", "streamable")
    return tags.agg(F.count("*").alias("total_tags"), *[F.count_if(P.in_class(F.col("tag_type"), n)).alias(n) for n in names])


def priority_analysis(entries: DataFrame, eff: str = "eff", size: str = "size") -> DataFrame:
    """AGG-06..08, 13..15: a row for each category that occurs, with its share of files and bytes in hundredths."""
    per = entries.groupBy(P.category(F.col(eff)).alias("category")).agg(
        F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"), F.min(eff).cast("int").alias("min_priority"), F.max(eff).cast("int").alias("max_priority"), F.avg(size).alias("avg_bytes")
    )
    w = Window.partitionBy()  # over five rows at most
    return per.select(
        "*",
        ratio(F.col("files") * 100, F.sum("files").over(w), 0.0).alias("files_percent"),
        ratio(F.col("bytes") * 100, F.sum("bytes").over(w), 0.0).alias("bytes_percent"),
        P.category_weight(F.col("category")).alias("weight"),
    )


def essential_summary(entries: DataFrame, eff: str = "eff", size: str = "size", mib_per_second: float = 10.0) -> DataFrame:
    """AGG-09..12, 22, 24: essential and streamable bytes, their shares, streaming potential, time until playable."""
    essential = F.coalesce(F.sum(F.when(F.col(eff) <= 0, F.col(size))), F.lit(0)).cast("long")
    t = entries.agg(F.count("*").alias("files"), total(size).alias("bytes"), essential.alias("essential_bytes"))
    t = t.withColumn("streamable_bytes", F.col("bytes") - F.col("essential_bytes"))
    pe, ps = ratio(F.col("essential_bytes") * 100, F.col("bytes"), 0.0), ratio(F.col("streamable_bytes") * 100, F.col("bytes"), 0.0)
    return t.select("*", pe.alias("essential_percent"), ps.alias("streamable_percent"), ((ps > 20) & (pe < 80)).alias("good_streaming"), (F.col("essential_bytes") / (1024.0 * 1024.0) / mib_per_second).alias("seconds_to_playable"))


def size_stats(entries: DataFrame, size: str = "size") -> DataFrame:
    """AGG-18..20, 23, 24, 35, 42: counts, total, mean, large files."""
    n = F.count("*")
    large = F.count_if(P.is_large(F.col(size)))
    return entries.agg(n.alias("files"), total(size).alias("bytes"), ratio(total(size), n, 0.0).alias("mean_bytes"), large.alias("large_files"), ratio(large * 100, n, 0.0).alias("large_percent"))


#: From so many values on, a group's search is narrowed to a few thousandths around the rank.
NARROW = 5000


def p95(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """AGG-56: the sorted value at index round(0.95 n), at most n - 1, for each key.

    Partial aggregates give bounds around the rank (wider than their error) and what lies below them; only the
    distinct values between the bounds are sorted, which are few thousandths of a large group.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    q = F.percentile_approx("__v", [0.949, 0.951, 1.0], 20_000)
    bounds = d.groupBy(*keys).agg(q.alias("__q"), F.count("*").alias("__n"))
    bounds = bounds.select(*keys, F.col("__q")[0].alias("__lo"), F.when(F.col("__n") < NARROW, F.col("__q")[2]).otherwise(F.col("__q")[1]).alias("__hi"), "__n")
    near = d.join(bounds, list(keys)) if keys else d.crossJoin(F.broadcast(bounds))  # without keys the bounds are one row
    below = near.where("__v < __lo").groupBy(*keys).agg(F.count("*").alias("__below"))
    counts = near.where("__v between __lo and __hi").groupBy(*keys, "__v").agg(F.count("*").alias("__c"), F.max("__n").alias("__n"))
    counts = counts.join(below, list(keys), "left") if keys else counts.crossJoin(F.broadcast(below))
    run = counts.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v")) + F.coalesce("__below", F.lit(0)))
    # half away from zero, as round() does for positive numbers
    at = F.least(F.floor(F.col("__n") * 95 / 100 + 0.5), F.col("__n") - 1)
    return run.where(F.col("__upto") > at).groupBy(*keys).agg(F.min("__v").alias("p95"), F.max("__n").cast("long").alias("n"))


def block_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG-32: records of each block, by its flags."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def hit_stats(events: DataFrame, keys: Sequence[str], hit: str = "was_hit", size: str = "size") -> DataFrame:
    """AGG-46, 48..51, 53, 54, 70: gets, hits, rate and bytes by key."""
    n, h = F.count("*"), F.count_if(F.col(hit))
    return events.groupBy(*keys).agg(n.alias("gets"), h.alias("hits"), ratio(h, n, 0.0).alias("hit_rate"), total(size).alias("bytes"))


def merge_snapshots(snapshots: DataFrame, sums: Sequence[str], most: Sequence[str], mean: str, count: str) -> DataFrame:
    """AGG-47: sums, largest limits, and the mean weighted by count, in integer division."""
    n = F.sum(count)
    return snapshots.agg(
        *[F.sum(c).cast("long").alias(c) for c in sums], *[F.max(c).alias(c) for c in most], n.cast("long").alias(count), F.when(n > 0, F.floor(F.sum(F.col(mean) * F.col(count)) / n)).otherwise(0).cast("long").alias(mean)
    )


def throughput(events: DataFrame, seconds: float) -> DataFrame:
    """AGG-52: events a second, 0 for an empty window."""
    return events.agg((F.count("*") / F.lit(seconds) if seconds > 0 else F.lit(0.0)).alias("ops_per_second"))


def success_rate(events: DataFrame, ok: str) -> DataFrame:
    """AGG-57: 1.0 without events."""
    return events.agg(F.coalesce(F.avg(F.col(ok).cast("double")), F.lit(1.0)).alias("success_rate"))


def efficiency(downloaded: Column, uploaded: Column) -> Column:
    """AGG-58: infinite if nothing was uploaded."""
    return F.when(uploaded == 0, F.lit(float("inf"))).otherwise(downloaded / uploaded)


def coalescing_gain(before: DataFrame, after: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """AGG-59: share of requests saved, and wanted bytes per fetched byte."""
    size = F.sum(F.col(end) - F.col(start) + 1)
    a, b = before.agg(F.count("*").alias("n0"), size.alias("b0")), after.agg(F.count("*").alias("n1"), size.alias("b1"))
    both = a.crossJoin(b)
    return both.select(F.when(F.col("n0") == 0, 0.0).otherwise(1 - F.col("n1") / F.col("n0")).alias("request_reduction"), F.when(F.coalesce("b1", F.lit(0)) == 0, 1.0).otherwise(F.col("b0") / F.col("b1")).alias("byte_efficiency"))


def network_condition(samples: DataFrame, ok: str, latency_ms: str, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-60, 65: five classes from success rate and mean latency."""
    rate, lat = F.coalesce(F.avg(F.col(ok).cast("double")), F.lit(1.0)), F.coalesce(F.avg(latency_ms), F.lit(0.0))
    t = samples.groupBy(*keys).agg(rate.alias("success_rate"), lat.alias("mean_ms"), F.count("*").alias("n"))
    c = F.when((F.col("success_rate") >= 0.98) & (F.col("mean_ms") < 100), "Excellent").when((F.col("success_rate") >= 0.95) & (F.col("mean_ms") < 250), "Good").when((F.col("success_rate") >= 0.9) & (F.col("mean_ms") < 500), "Fair").when(F.col("success_rate") >= 0.7, "Poor").otherwise("Critical")
    return t.withColumn("condition", c)


def distinct_sorted(df: DataFrame, c: Column, name: str) -> DataFrame:
    """AGG-05, 27, 37: distinct values in order; nulls are left out."""
    return df.select(c.alias(name)).where(F.col(name).isNotNull()).distinct().orderBy(name)


def check_total(entries: DataFrame, stated: int, size: str = "esize") -> DataFrame:
    """AGG-34, VAL-01, 02: does the stated total agree?"""
    return entries.agg(total(size).alias("total"), (total(size) == stated).alias("valid"))


def available(names: Sequence[tuple[Column, str]]) -> Column:
    """AGG-62: names of the columns that are not null, in the given order."""
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for c, n in names]))


def verify_content(content: DataFrame, data: str, key: str) -> DataFrame:
    """AGG-43, 44: rows, and how many have bytes that match their key; nothing is taken as valid unseen."""
    ok = F.coalesce(F.md5(data) == F.lower(F.hex(key)), F.lit(False))
    return content.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def root_stats(root: DataFrame, stated_files: Column | None = None) -> DataFrame:
    """AGG-29..31, 45: files, named files, distinct ids and names."""
    n = F.count("*")
    return root.agg((n if stated_files is None else F.coalesce(stated_files, n)).cast("long").alias("files"), F.count("name_hash").alias("named"), F.countDistinct("fdid").alias("ids"), F.countDistinct("name_hash").alias("names"))


def raw_bucket_counts(base: DataFrame, log: DataFrame) -> DataFrame:
    """AGG-39, 40: entries per bucket, base and log together, repeats included."""
    return base.select("bucket").unionByName(log.select("bucket")).groupBy("bucket").agg(F.count("*").alias("entries"))
