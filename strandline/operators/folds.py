"""Ordered windows and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.merges import grouped_fold


def latest_per_group(df: DataFrame, keys: Sequence[str], newest: str, pos: str) -> DataFrame:
    """WIN-01: the row with the greatest text of ``newest``, the first in file order on ties, without a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(newest, (-F.col(pos)).alias("p"))).alias("__r")).select(*keys, "__r.*")


def moving_average(df: DataFrame, keys: Sequence[str], ts: str, value: str, interval: str, name: str = "moving_avg") -> DataFrame:
    """WIN-02, 24: mean over the time window that ends at each row, cutoff included, rounded down."""
    by = f"partition by {', '.join(keys)} " if keys else ""
    frame = f"{by}order by {ts} range between interval {interval} preceding and current row"
    return df.selectExpr("*", f"cast(floor(avg({value}) over ({frame})) as bigint) as {name}")


def running_stats(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """WIN-03: peak and exact mean so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("peak", F.max(value).over(w)).withColumn("mean", F.avg(value).over(w))


def recommended_size(rate: Column, seconds: float) -> Column:
    """WIN-04: bytes to ask for, within 64 KiB and 32 MiB; 1 MiB without a rate."""
    return F.when(rate.isNull() | (rate <= 0), F.lit(1 << 20)).otherwise(F.greatest(F.lit(1 << 16), F.least(F.lit(1 << 25), (rate * seconds).cast("long")))).cast("long")


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.1, seed: Column | None = None, truncate: bool = False) -> DataFrame:
    """WIN-05, 06, 23: exponential mean of each group in order, seeded by its first value or by ``seed``.

    A group's samples are one sorted array; groups are the servers or key kinds of a log window, which the
    caller bounds.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v"))))
    g = df.groupBy(*keys).agg(rows.alias("__a"))
    first = F.col("__a")[0]["__v"] if seed is None else seed
    rest = F.slice("__a", 2, F.size("__a")) if seed is None else F.col("__a")

    def step(acc: Column, x: Column) -> Column:
        nxt = acc * (1 - alpha) + x["__v"] * alpha
        return F.floor(nxt).cast("double") if truncate else nxt

    return g.select(*keys, F.aggregate(rest, first.cast("double"), step).alias("ema"), F.size("__a").cast("long").alias("n"))


def access_patterns(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: str, size: str, least: int = 1) -> DataFrame:
    """WIN-06, 07: count, hit rate by an exponential mean from 0, and mean size; keys with at least ``least`` accesses."""
    e = ema(df.withColumn("__h", F.col(hit).cast("double")), keys, order, "__h", seed=F.lit(0.0))
    s = df.groupBy(*keys).agg(F.avg(size).alias("mean_size"))
    return e.join(s, list(keys)).where(F.col("n") >= least).withColumnRenamed("ema", "hit_rate").orderBy(F.desc("n"), *keys)


def coalesce_ranges(df: DataFrame, keys: Sequence[str], gap: int, most: int | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """WIN-08: ranges with inclusive ends, merged where they overlap, touch or leave at most ``gap`` bytes, then cut to ``most``."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(far.isNull() | (F.col(start) - far - 1 > gap), 1).otherwise(0)
    island = df.withColumn("__new", new).withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__i")
    if most is None:
        return out
    from strandline.operators.merges import split_ranges

    return split_ranges(out, most, start, end)


def coalesce_capped(df: DataFrame, keys: Sequence[str], gap: int, cap: int, start: str = "start", end: str = "end") -> DataFrame:
    """WIN-09: greedy merging in order of start that never lets a range outgrow ``cap``; the size is tested before extending."""
    kind = T.StructType([*[df.schema[k] for k in keys], T.StructField(start, T.LongType()), T.StructField(end, T.LongType())])

    def fold(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for r in rows:
            last = out[-1] if out else None
            if last and r[start] <= last[end] + 1 + gap and max(last[end], r[end]) - last[start] + 1 <= cap:
                last[end] = max(last[end], r[end])
            else:
                out.append({k: r[k] for k in [*keys, start, end]})
        return out

    return grouped_fold(df.select(*keys, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end)), keys, [start, end], fold, kind)


def dynamic_gap(base: int, bandwidth: Column) -> Column:
    """WIN-10: the gap worth bridging, scaled 0.5, 1, 2 or 3 times by bandwidth (bytes a second)."""
    mib = 1 << 20
    scale = F.when(bandwidth < mib, 0.5).when(bandwidth < 5 * mib, 1.0).when(bandwidth < 20 * mib, 2.0).otherwise(3.0)
    return (F.lit(base) * scale).cast("long")


def overlapping_spans(df: DataFrame, keys: Sequence[str], offset: str = "offset", size: str = "size") -> DataFrame:
    """WIN-11: spans that start before an earlier one's end; touching is allowed."""
    w = Window.partitionBy(*keys).orderBy(offset, size).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__e", F.max(F.col(offset) + F.col(size)).over(w)).where(F.col("__e") > F.col(offset)).drop("__e")


def unsorted_rows(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """WIN-12, 13, 16; VAL-04: rows whose value is less than the one before, with their position (the real one)."""
    w = Window.partitionBy(*keys).orderBy(pos)
    return df.withColumn("__p", F.lag(value).over(w)).where(F.col("__p") > F.col(value)).drop("__p")


def delta_decode(df: DataFrame, keys: Sequence[str], pos: str, delta: str, name: str = "id") -> DataFrame:
    """WIN-14: ids from deltas: the running sum, plus one for each row before."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, (F.sum(delta).over(w) + F.count(F.lit(1)).over(w) - 1).cast("long"))


def delta_encode(df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str = "delta") -> DataFrame:
    """WIN-15: deltas of ids; the first one's is the id itself."""
    w = Window.partitionBy(*keys).orderBy(pos)
    return df.withColumn(name, (F.col(value) - F.lag(value, 1, -1).over(w) - 1).cast("long"))


def server_score(priority: Column, https: Column, success: Column, latency_ms: Column, bandwidth: Column, recency: Column, failures: Column) -> Column:
    """WIN-17: the score of a server; each failure in a row takes a tenth."""
    s = F.lit(100.0) + F.lit(1000.0) / (priority + 1) + F.when(https, 10.0).otherwise(0.0) + success * 50.0 - latency_ms + bandwidth + recency
    return s * F.pow(F.lit(0.9), failures)


def weighted_pick(df: DataFrame, score: str, draw: float, order: str) -> DataFrame:
    """WIN-18: the row where the running share of the scores passes ``draw`` (0 to 1); servers are few."""
    w = Window.orderBy(order)
    s = F.greatest(F.col(score), F.lit(0.0))
    run = df.withColumn("__u", F.sum(s).over(w)).withColumn("__t", F.sum(s).over(Window.partitionBy()))
    return run.where(F.col("__u") > F.col("__t") * draw).orderBy(order).limit(1).drop("__u", "__t")


def should_break(df: DataFrame, keys: Sequence[str], ok: str, ts: str, now: Column) -> DataFrame:
    """WIN-19: keys with ten requests or more, under half of them successful, and a failure in the last minute."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(ok).cast("double")).alias("rate"), F.max(F.when(~F.col(ok), F.col(ts))).alias("last_failure"))
    return g.where((F.col("n") >= 10) & (F.col("rate") < 0.5) & (F.col("last_failure") >= now - F.expr("INTERVAL 60 SECONDS")))


def allocate(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, capacity: int) -> DataFrame:
    """WIN-20: first-fit placement of blobs in segments of ``capacity``: segment number and offset."""
    kind = T.StructType([*df.schema.fields, T.StructField("segment", T.LongType()), T.StructField("segment_offset", T.LongType())])

    def fold(rows: list[dict]) -> list[dict]:
        used: list[int] = []
        for r in rows:
            k = next((i for i, u in enumerate(used) if u + r[size] <= capacity), len(used))
            if k == len(used):
                used.append(0)
            r["segment"], r["segment_offset"] = k, used[k]
            used[k] += r[size]
        return rows

    return grouped_fold(df, keys, order, fold, kind)


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """WIN-21: keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1000) -> DataFrame:
    """WIN-22: the last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def with_offsets(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, name: str = "offset") -> DataFrame:
    """SNK-12, WIN-20 with one segment: where each blob lies when all are appended in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))

