"""Sorts, limits and plans."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import priority as P


def download_plan(entries: DataFrame, most: int | None = None, categories: Sequence[str] | None = None, eff: str = "eff", idx: str = "idx") -> DataFrame:
    """ORD-02..05: entries to fetch, up to a priority and in some categories, with their place by (priority, index)."""
    out = entries.withColumn("category", P.category(F.col(eff)))
    if most is not None:
        out = out.where(F.col(eff) <= most)
    if categories is not None:
        out = out.where(F.col("category").isin(*categories))
    return out.orderBy(eff, idx)


def with_place(plan: DataFrame, eff: str = "eff", idx: str = "idx", run: int = 1 << 16, name: str = "place") -> DataFrame:
    """ORD-02: each entry's place from 1 on by (priority, index), without one sorted whole.

    Rows are numbered within a priority and a run of indexes; the runs before are counted in a table of one row a run.
    """
    dealt = plan.withColumn("__run", F.floor(F.col(idx) / run))
    counts = dealt.groupBy(eff, "__run").agg(F.count("*").alias("__c"))
    w = Window.orderBy(eff, "__run").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(eff, "__run", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__before"))
    own = dealt.withColumn("__k", F.row_number().over(Window.partitionBy(eff, "__run").orderBy(idx)))
    return own.join(before, [eff, "__run"]).withColumn(name, (F.col("__before") + F.col("__k")).cast("long")).drop("__run", "__before", "__k")


def plan_totals(plan: DataFrame, size: str = "size") -> DataFrame:
    """AGG-17: files and bytes of a plan by category."""
    return plan.groupBy("category").agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"))


def plan_seconds(total_bytes: Column, mib_per_second: float) -> Column:
    """ORD-06."""
    return total_bytes / (1024.0 * 1024.0) / mib_per_second


def evict(entries: DataFrame, k: int, by: str, key: str = "key", seed: int = 0) -> DataFrame:
    """ORD-07..10: the k entries to evict: least recently (``lru``) or frequently (``lfu``) used, oldest (``fifo``), or by a seeded hash (``random``)."""
    order = {"lru": F.col("last_access"), "lfu": F.col("n_access"), "fifo": F.col("created"), "random": F.xxhash64(F.lit(seed), key)}[by]
    return entries.orderBy(order, key).limit(k)


def expired(entries: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """ORD-11: entries past their time."""
    return entries.where(F.col(expires) <= now)


def evict_to_target(entries: DataFrame, target: int, mean_size: int, order: Sequence[str]) -> DataFrame:
    """ORD-12: the least recently used entries that free the target at a fixed mean size."""
    return entries.orderBy(*order).limit(math.ceil(target / mean_size) if mean_size > 0 else 0)


def queue_order(requests: DataFrame) -> DataFrame:
    """ORD-13, STR-15: by priority, then age, then id."""
    return requests.orderBy("priority", "created_at", "id")


def primary_server(servers: DataFrame) -> DataFrame:
    """ORD-16: https only, the lowest priority, the first on ties."""
    return servers.where("https").orderBy("priority", "pos").limit(1)


def latest_generation(files: DataFrame) -> DataFrame:
    """ORD-17, SET-32: the file of the highest generation."""
    return files.orderBy(F.desc("generation")).limit(1)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark prunes within partitions before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
