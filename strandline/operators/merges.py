"""Merges, logs and mutations."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_first(parts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SET-01, 02, 28: one row a key, the lowest in order (source, position). A partial aggregate, not a window."""
    rest = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def latest(log: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """SET-12, 31; STR-16: the last row of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("__r")).select(*keys, "__r.*")


def log_view(base: DataFrame, log: DataFrame, keys: Sequence[str], seq: str = "seq", status: str = "status", dead: Sequence[str] = ("Delete",)) -> DataFrame:
    """SET-06, 07; JN-18; STR-17; FLT-42: the base overlaid by its log, newest wins, dead keys removed."""
    b = base.withColumn(seq, F.lit(-1).cast("long")).withColumn(status, F.lit("Normal"))
    both = b.unionByName(log.withColumn(seq, F.col(seq).cast("long")), allowMissingColumns=True)
    return latest(both, keys, [seq]).where(~F.col(status).isin(*dead)).drop(seq, status)


def append_log(log: DataFrame, changes: DataFrame, status: str, seq: str = "seq") -> DataFrame:
    """SET-08..11, 18; STR-18: changes at the end of a log, as one batch in the order of their ``pos``."""
    top = log.agg(F.coalesce(F.max(seq), F.lit(0)).cast("long").alias("__top"))
    new = changes.crossJoin(F.broadcast(top)).withColumn(seq, F.col("__top") + F.col("pos") + 1).withColumn("status", F.lit(status)).drop("__top", "pos")
    return log.unionByName(new, allowMissingColumns=True)


#: Numbers to a bucket of ``remove_and_renumber``.
RUN = 1024


def remove_and_renumber(files: DataFrame, bridge: DataFrame, gone: DataFrame, idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """SET-13: files and bridge without some files, numbered anew from 0.

    The new number is the old one less the removed ones before it: those in earlier buckets of ``RUN`` numbers,
    from a running count over one row a bucket, and those in its own bucket, which are ``RUN`` at most.
    """
    run = lambda c: F.floor(F.col(c) / RUN)
    g = gone.select(idx).distinct()
    own = g.groupBy(run(idx).alias("__b")).agg(F.array_sort(F.collect_list(idx)).alias("__ids"))
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = files.select(run(idx).alias("__b")).distinct().join(own, "__b", "left")
    before = buckets.withColumn("__before", F.coalesce(F.sum(F.coalesce(F.size("__ids"), F.lit(0))).over(w), F.lit(0)))

    def shifted(df: DataFrame) -> DataFrame:
        kept = df.join(g, idx, "left_anti").withColumn("__b", run(idx)).join(before, "__b", "left")
        inside = F.coalesce(F.size(F.filter("__ids", lambda x: x < F.col(idx))), F.lit(0))
        return kept.withColumn(idx, (F.col(idx) - F.col("__before") - inside).cast(df.schema[idx].dataType)).select(*df.columns)

    return shifted(files), shifted(bridge)


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET-14, 16, 18, 25, 26: rows whose keys are not listed."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def without_prefix(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """SET-22: rows whose key agrees with no listed key over the shorter one's length."""
    g = gone.select(F.col(key).alias("__g"), F.octet_length(key).alias("__n")).distinct()
    sizes = [r["__n"] for r in g.select("__n").distinct().collect()]
    out = df
    for n in sizes:  # key lengths are few: each is one equality join
        part = g.where(F.col("__n") == n).select("__g")
        out = out.join(part, F.substring(key, 1, n) == F.substring("__g", 1, n), "left_anti")
    return out


def associate(bridge: DataFrame, rows: DataFrame) -> DataFrame:
    """SET-05, 15, 26, 30; SNK-42: union without repeats."""
    return bridge.unionByName(rows).distinct()


def intersect_tags(bridge: DataFrame, a: str, b: str) -> DataFrame:
    """SET-04: files in both tags."""
    return bridge.where(F.col("tag") == a).select("idx").intersect(bridge.where(F.col("tag") == b).select("idx"))


def union_tags(bridge: DataFrame, a: str, b: str) -> DataFrame:
    """SET-05: files in either tag."""
    return bridge.where(F.col("tag").isin(a, b)).select("idx").distinct()


def update_values(df: DataFrame, changes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """SET-17: new values where listed; never inserts."""
    return df.join(changes.select(*keys, F.col(value).alias("__new")), list(keys), "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def merge_servers(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """SET-19: primary hosts win; new fallback hosts follow at priority + (highest primary priority + 100, or 1000)."""
    top = primary.agg(F.coalesce(F.max("priority") + 100, F.lit(1000)).alias("__shift"))
    new = fallback.join(primary.select("host"), "host", "left_anti").crossJoin(F.broadcast(top))
    return primary.unionByName(new.withColumn("priority", (F.col("priority") + F.col("__shift")).cast(primary.schema["priority"].dataType)).drop("__shift").select(*primary.columns)).orderBy("priority", "host")


def split_ranges(df: DataFrame, size: int, start: str = "start", end: str = "end") -> DataFrame:
    """SET-24: ranges with inclusive ends, cut in pieces of ``size``."""
    piece = F.explode(F.sequence(F.col(start), F.col(end), F.lit(size).cast("long")))
    rest = [c for c in df.columns if c not in (start, end)]
    return df.select(*rest, piece.alias("__s"), F.col(end).alias("__e")).select(*rest, F.col("__s").alias(start), F.least(F.col("__s") + (size - 1), F.col("__e")).alias(end))


def not_expired(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """SRC-54, FLT-39, 56: rows still valid; a null expiry never expires."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def grouped_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable[[list[dict]], list[dict]], schema: T.StructType) -> DataFrame:
    """WIN-09, 20: an order-dependent greedy fold of each group, whose size its caller bounds."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([(o, "ascending") for o in order]).to_pylist()
        out = fold(rows)
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.Table.from_pylist(out, schema=to_arrow_schema(schema))

    return df.groupBy(*keys).applyInArrow(run, schema)


def merge_plan(segments: DataFrame, threshold: float, capacity: int) -> DataFrame:
    """SET-20: which sparse segments move where: from the emptiest on, each into the fullest sparse segment with room.

    A destination starts at its used bytes. ``segments(group, segment, used, size)``.
    """
    kind = T.StructType([T.StructField("group", T.LongType()), T.StructField("source", T.LongType()), T.StructField("target", T.LongType()), T.StructField("offset", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("used", "ascending"), ("segment", "ascending")])
        moves = _moves(table["segment"].to_pylist(), table["used"].to_pylist(), capacity)
        from pyspark.sql.pandas.types import to_arrow_schema

        cols = list(zip(*moves, strict=True)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array([table["group"][0].as_py()] * len(moves), pa.int64()), *[pa.array(c, pa.int64()) for c in cols]], schema=to_arrow_schema(kind))

    sparse = segments.where((F.col("size") != 0) & (F.col("used") > 0) & (F.col("used") < F.lit(threshold) * F.col("size")))
    return sparse.select("group", "segment", "used").groupBy("group").applyInArrow(run, kind)


def _moves(segments: list[int], used: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """Moves (source, target, offset) of segments in the order of their used bytes.

    The room asked for only grows, and so do the fills: a segment that is too full once stays so and leaves the heap for
    good. The fullest that is left is the target, the lowest number of equally full ones.
    """
    fill = dict(zip(segments, used, strict=True))
    heap = [(-f, s) for s, f in fill.items()]
    heapq.heapify(heap)
    gone, targets, out = set(), set(), []
    for s, u in zip(segments, used, strict=True):
        if s in targets:
            continue
        own = None
        while heap and (heap[0][1] in gone or -heap[0][0] + u > capacity or heap[0][1] == s):
            top = heapq.heappop(heap)
            if top[1] == s and s not in gone and -top[0] + u <= capacity:
                own = top
        if heap:
            to = heap[0][1]
            out.append((s, to, fill[to]))
            fill[to] += u
            heapq.heapreplace(heap, (-fill[to], to))
            targets.add(to)
            gone.add(s)
        elif own:
            heapq.heappush(heap, own)
    return out


def compact_offsets(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET-21, SNK-12: live spans slide left in the order of their offsets."""
    w = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("new_offset", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))
