"""Lookups and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which one side of a lookup is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The frame, marked for broadcast if it has at most so many rows and bytes (as text; no more than ``rows`` + 1 are looked at)."""
    seen = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if seen["n"] <= rows and seen["b"] <= size else df


def first_match(requests: DataFrame, table: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column | None = None, how: str = "inner") -> DataFrame:
    """JN-01, 02, 43: for each key of the requests, the first row of the table in file order that passes.

    The table is reduced to one row a key by a partial aggregate before the join, so a key with many rows costs
    no skewed window.
    """
    t = table if condition is None else table.where(condition)
    rest = [c for c in t.columns if c not in keys]
    best = t.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")
    return requests.join(best, list(keys), how)


def all_matches(requests: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-04, 05, 07, 12..16, 20, 42, 44: every row of the table with a requested key."""
    return requests.join(table, list(keys), "inner")


def batch_probe(requests: DataFrame, table: DataFrame, key: str, value: str, pos: str = "pos", miss: Column | None = None) -> DataFrame:
    """JN-09..11, 28; STR-12: one row for each request, misses kept (or ``miss``), with its position to sort by."""
    v = F.col(value) if miss is None else F.coalesce(value, miss)
    return requests.join(table.select(key, value), key, "left").select(pos, key, v.alias(value))


def resolve_chain(requests: DataFrame, steps: Sequence[tuple[DataFrame, str, str]], stage: str = "missing_stage") -> DataFrame:
    """JN-21..24, 41: follow ``(table, from, to)`` steps; ``stage`` names the first step without a match, else null.

    Each table has one row a key.
    """
    out = requests.withColumn(stage, F.lit(None).cast("string"))
    for table, src, dst in steps:
        t = table.select(F.col(src).alias("__k"), F.col(dst).alias("__v"))
        out = out.join(t, F.col(src) == F.col("__k"), "left").drop("__k")
        out = out.withColumn(stage, F.when(F.col(stage).isNull() & F.col("__v").isNull(), F.lit(dst)).otherwise(F.col(stage))).withColumnRenamed("__v", dst)
    return out


def resolve_all(requests: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-25..27: inner join that fails as a whole if any request has no match."""
    t = table.withColumn("__hit", F.lit(True))
    return requests.join(t, list(keys), "left").where(F.when(F.col("__hit").isNull(), F.raise_error(F.lit("a request has no match"))).otherwise(F.lit(True))).drop("__hit")


def exists(requests: DataFrame, table: DataFrame, keys: Sequence[str], negate: bool = False) -> DataFrame:
    """JN-29, 33: requests with a match (or without)."""
    return requests.join(table.select(*keys).distinct(), list(keys), "left_anti" if negate else "left_semi")


def probe_then_fallback(requests: DataFrame, cache: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """JN-38, 47: the cached value, else the source's; ``origin`` says which, null if neither has the key."""
    hit = requests.join(cache.select(key, F.col(value).alias("__c")), key, "left")
    both = hit.join(source.select(key, F.col(value).alias("__s")), key, "left")
    origin = F.when(F.col("__c").isNotNull(), "cache").when(F.col("__s").isNotNull(), "source")
    return both.select(*requests.columns, F.coalesce("__c", "__s").alias(value), origin.alias("origin"))


def resolve_ordered(requests: DataFrame, layers: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """JN-39, STR-11: the value of the first layer that has the key, and that layer's number."""
    out = requests
    for i, layer in enumerate(layers):
        out = out.join(layer.select(key, F.col(value).alias(f"__{i}")), key, "left")
    cols = [F.col(f"__{i}") for i in range(len(layers))]
    number = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(cols)])
    return out.select(*requests.columns, F.coalesce(*cols).alias(value), number.alias("layer"))


def in_any_tag(files: DataFrame, bridge: DataFrame, tags: Sequence[str], idx: str = "idx", tag: str = "tag") -> DataFrame:
    """FLT-07, 09, 13: files in any of the tags; unknown tags are ignored."""
    return files.join(bridge.where(F.col(tag).isin(*tags) if tags else F.lit(False)).select(idx), idx, "left_semi")


def in_all_tags(files: DataFrame, bridge: DataFrame, tags: Sequence[str], empty_means_all: bool = False, idx: str = "idx", tag: str = "tag") -> DataFrame:
    """FLT-08, 14, 15: relational division. An unknown tag gives nothing; an empty list nothing or, for downloads, all."""
    want = sorted(set(tags))
    if not want:
        return files if empty_means_all else files.where(F.lit(False))
    have = bridge.where(F.col(tag).isin(*want)).groupBy(idx).agg(F.countDistinct(tag).alias("__n")).where(F.col("__n") == len(want)).select(idx)
    return files.join(have, idx, "left_semi")


def overlap_join(ranges: DataFrame, queries: DataFrame, keys: Sequence[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """JN-32: pairs of a range and a query of the same keys that overlap, half-open ``[start, end)``.

    Both sides are cut in bins of ``width``, so the join is on equality of keys and bin; a pair is kept in the
    bin where the later of the two starts, so it comes out once. Empty ranges overlap nothing.
    """

    def binned(df: DataFrame, p: str) -> DataFrame:
        d = df.where(F.col(start) < F.col(end)).select(*keys, *[F.col(c).alias(f"{p}{c}") for c in df.columns if c not in keys])
        return d.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(f"{p}{start}") / width), F.floor((F.col(f"{p}{end}") - 1) / width))))

    a, b = binned(ranges, "r_"), binned(queries, "q_")
    s, e = (f"r_{start}", f"q_{start}"), (f"r_{end}", f"q_{end}")
    hit = (F.col(s[0]) < F.col(e[1])) & (F.col(s[1]) < F.col(e[0])) & (F.col("__bin") == F.floor(F.greatest(*s) / width))
    return a.join(b, [*keys, "__bin"]).where(hit).drop("__bin")


def offset_lookup(requests: DataFrame, blocks: DataFrame, offset: str, pos: str, size: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """JN-34: the value of the block that holds an offset; beyond the last block, the last one's.

    Blocks are laid end to end in the order of ``pos`` (per ``keys``). A block table is short, so its bounds go
    into one array a key and each request searches that; nothing is joined by inequality.
    """
    w = Window.partitionBy(*keys).orderBy(pos) if keys else Window.orderBy(pos)
    ends = blocks.select(*keys, pos, value, F.sum(size).over(w).alias("__end"))
    table = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("__end").alias("e"), F.col(value).alias("v")))).alias("__t"))
    joined = requests.join(table, list(keys), "left") if keys else requests.crossJoin(F.broadcast(table))
    hit = F.try_element_at(F.filter("__t", lambda b: b["e"] > F.col(offset)), F.lit(1))["v"]
    return joined.withColumn(value, F.coalesce(hit, F.try_element_at("__t", F.lit(-1))["v"])).drop("__t")


def group_requests(requests: DataFrame, index: DataFrame, key: str, archive: str, offset: str, size: str) -> DataFrame:
    """JN-35, 36, 49; SRC-51, 53: requests with a location, to be read archive by archive in order of offset."""
    return requests.join(index.select(key, archive, offset, size), key).repartition(archive).sortWithinPartitions(archive, offset)


def validated(content: DataFrame, data: str, key: str) -> DataFrame:
    """JN-45, VAL-12, 24: rows whose bytes have the MD5 that their key says."""
    return content.where(F.md5(data) == F.lower(F.hex(key)))


def key_by_id(requests: DataFrame, keys: DataFrame, key_id: str = "key_id", value: str = "key_value", pos: str = "pos") -> DataFrame:
    """JN-37: key by id, case-insensitive, the first entry wins."""
    low = keys.select(F.lower(key_id).alias("__id"), value, pos)
    best = low.groupBy("__id").agg(F.min_by(value, pos).alias(value))
    return requests.join(best, F.lower(key_id) == F.col("__id"), "left").drop("__id")


def build_location_map(indexes: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """JN-17: one location a key from many indexes; the last in order wins."""
    return indexes.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v")).select(key, "__v.*")


def vfs_resolve(paths: DataFrame, spans: DataFrame, containers: DataFrame) -> DataFrame:
    """JN-30, 31: path -> first span -> container; paths without spans are kept."""
    first = spans.select(F.col("offset").alias("vfs_offset"), F.try_element_at("spans", F.lit(1)).alias("span"))
    c = containers.select(F.col("offset").alias("__o"), "ekey", "encoded_size")
    return paths.join(first, "vfs_offset", "left").join(c, F.col("span.cft_offset") == F.col("__o"), "left").drop("__o")
