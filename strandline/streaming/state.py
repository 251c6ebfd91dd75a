"""Structured Streaming: caches, residency, breakers and event-time windows.

Stateful operators use ``applyInPandasWithState``; each has a batch twin over the same fold, which tests compare.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LRU_OUT = "cache_id long, seq long, key string, hit boolean, evicted string"
LRU_STATE = "keys array<string>"


def lru_fold(keys: list[str], touches: list[tuple[int, str]], capacity: int) -> tuple[list[str], list[tuple[int, str, bool, str | None]]]:
    """STR-06: touches in order against a cache of ``capacity`` keys, the most recent last."""
    order = dict.fromkeys(keys)
    out = []
    for seq, key in touches:
        hit = key in order
        order.pop(key, None)
        evicted = None
        if not hit and len(order) >= capacity:
            evicted = next(iter(order))
            del order[evicted]
        order[key] = None
        out.append((seq, key, hit, evicted))
    return list(order), out


def lru_stream(touches: DataFrame, capacity: int) -> DataFrame:
    """STR-06, 08, 09: (cache_id, seq, key, hit, evicted) for a stream of (cache_id, seq, key).

    A key's state is one cache of bounded capacity; the number of caches spreads the load.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        keys = list(state.get[0]) if state.exists else []
        keys, out = lru_fold(keys, list(zip(pdf["seq"].tolist(), pdf["key"].tolist(), strict=True)), capacity)
        state.update((keys,))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["cache_id", "seq", "key", "hit", "evicted"])

    return touches.groupBy("cache_id").applyInPandasWithState(step, LRU_OUT, LRU_STATE, "append", GroupStateTimeout.NoTimeout)


#: Touches of all caches to a chunk of ``lru_batch``.
LRU_ROWS = 200_000


def lru_batch(touches: DataFrame, capacity: int, rows: int = LRU_ROWS) -> DataFrame:
    """The same over a bounded table, a chunk of each cache's log at a time.

    A cache holds the keys touched last, whatever came before. So the last ``capacity`` keys of each chunk give the
    state at the start of every later one, and chunks are folded side by side.
    """
    n = max(1, math.ceil(touches.count() / rows))
    bounds = np.array(touches.approxQuantile("seq", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else [])

    @F.pandas_udf("int")
    def chunk(seq: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, seq.to_numpy(float), side="right").astype(np.int32))

    t = touches.select("cache_id", "seq", "key").withColumn("chunk", chunk("seq"))
    last = t.groupBy("cache_id", "chunk", "key").agg(F.max("seq").alias("seq"))
    newest = Window.partitionBy("cache_id", "chunk").orderBy(F.desc("seq"), F.desc("key"))
    last = last.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= capacity)

    def starts(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "ascending"), ("r", "descending")])
        order: dict = {}
        chunks, keys = [], []
        for c, key in zip(table["chunk"].to_pylist(), table["key"].to_pylist(), strict=True):
            if not chunks or chunks[-1] != c:
                order = dict.fromkeys(list(order)[-capacity:])
                chunks.append(c)
                keys.append(list(order))
            order.pop(key, None)
            order[key] = None
        return pa.table({"cache_id": pa.array([table["cache_id"][0].as_py()] * len(chunks), pa.int64()), "chunk": pa.array(chunks, pa.int32()), "keys": pa.array(keys, pa.list_(pa.string()))})

    def step(table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by([("seq", "ascending"), ("key", "ascending")])
        _, out = lru_fold(start["keys"][0].as_py(), list(enumerate(table["key"].to_pylist())), capacity)
        return pa.table({"cache_id": table["cache_id"], "seq": table["seq"], "key": table["key"], "hit": pa.array([o[2] for o in out], pa.bool_()), "evicted": pa.array([o[3] for o in out], pa.string())})

    start = last.groupBy("cache_id").applyInArrow(starts, "cache_id long, chunk int, keys array<string>")
    return t.groupBy("cache_id", "chunk").cogroup(start.groupBy("cache_id", "chunk")).applyInArrow(step, LRU_OUT)


#: Fixed values, STR-14: seconds that a server is left out after an error of a class; none for a missing file.
UNAVAILABLE = {"timeout": 300, "network": 300, "rate_limited": 60, "server_error": 900, "not_found": 0, "other": 300}


def _timed(df: DataFrame) -> DataFrame:
    """Event time as an instant: watermarks do not take timestamps without a zone. Those are read in the session's zone."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def unavailable_until(error: Column, ts: Column) -> Column:
    """STR-14: when a server may be asked again after an error."""
    seconds = F.lit(UNAVAILABLE["other"])
    for name, s in UNAVAILABLE.items():
        seconds = F.when(error == name, F.lit(s)).otherwise(seconds)
    return F.timestamp_seconds(F.unix_timestamp(ts) + seconds)


def breaker_stream(errors: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """STR-14 as a stream: for each server the time until which it is left out, over event-time windows with a watermark."""
    return _timed(errors).withWatermark("ts", delay).groupBy(F.window("ts", delay), "server").agg(F.max(unavailable_until(F.col("error"), F.col("ts"))).alias("until"), F.count("*").alias("errors"))


def reassemble(chunks: DataFrame, doc: str = "doc", idx: str = "idx", data: str = "data") -> DataFrame:
    """STR-01..03: contents from chunk rows in order; ``valid`` compares with a ``key`` column if there is one (an external key)."""
    rows = F.array_sort(F.collect_list(F.struct(idx, data)))
    joined = F.aggregate(F.transform(rows, lambda r: r[data]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    keyed = [F.first("key").alias("key")] if "key" in chunks.columns else []
    out = chunks.groupBy(doc).agg(joined.alias("content"), F.count("*").alias("chunks"), *keyed)
    return out.withColumn("valid", F.md5("content") == F.lower(F.hex("key"))) if keyed else out


def residency_view(events: DataFrame) -> DataFrame:
    """STR-16..18, FLT-42, AGG-67: the latest state of each key; ``resident`` is false after a removal."""
    last = events.groupBy("bucket", "ekey").agg(F.max_by(F.struct("update_type", "span"), "seq").alias("r"))
    return last.select("bucket", "ekey", "r.update_type", "r.span", (~F.col("r.update_type").isin("Delete", "MarkNonResident")).alias("resident"))


def windowed_counts(events: DataFrame, window: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Extension: tumbling or sliding event-time counts and sums, late rows dropped by the watermark."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    events = _timed(events)
    out = events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Extension: sessions of each user, ended by a gap."""
    out = _timed(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def each_batch(df: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """EXT-07: a callback for each micro-batch; ``once`` ends when what is there has been read."""
    w = df.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def stream_schema() -> T.StructType:
    """The schema of the ``events`` table, for ``readStream``."""
    return T.StructType.fromDDL("event_id long, ts timestamp, user_id long, event_type string, value double, props string")
