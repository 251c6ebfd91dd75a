"""Lookups, filters and figures over the tables that the formats give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import paths as PA
from strandline.functions import priority as P
from strandline.functions.hashes import path_hash
from strandline.operators.lookups import first_match
from strandline.operators.merges import not_expired
from strandline.operators.topk import evict_to_target

# --- the central lookups --------------------------------------------------------------------------------------


def root_by_path(requests: DataFrame, root: DataFrame, locale: int, content: int = 0, path: str = "path") -> DataFrame:
    """JN-03, 19: the content key of each path: normalised, hashed, then the first row in file order of a fitting locale and content.

    Any shared bit fits a locale; all bits asked for fit the content flags. Paths without a match have a null key.
    """
    asked = requests.withColumn("name_hash", path_hash(PA.normalized(F.col(path))))
    table = root.where(F.col("name_hash").isNotNull()).select("name_hash", "ckey", "fdid", "version", "block", "pos", "locale_flags", "content_flags")
    return first_match(asked, table, ["name_hash"], ["block", "pos"], fits(F.col("locale_flags"), F.col("content_flags"), locale, content), "left").drop("name_hash", "version", "block", "pos", "locale_flags", "content_flags")


def encoding_key(requests: DataFrame, enc_ckey: DataFrame, ckey: str = "ckey") -> DataFrame:
    """JN-06: the first encoding key of each content key, of its first entry in file order; null without one."""
    table = enc_ckey.select(F.col("ckey").alias(ckey), F.try_element_at("ekeys", F.lit(1)).alias("ekey"), "file_size", "page", "pos")
    return first_match(requests, table, [ckey], ["page", "pos"], how="left").drop("page", "pos")


def encoding_spec(requests: DataFrame, enc_ekey: DataFrame, specs: DataFrame, ekey: str = "ekey") -> DataFrame:
    """JN-08: the spec string of each encoding key, through its number; null if either step has no match."""
    table = enc_ekey.select(F.col("ekey").alias(ekey), "espec_index", "page", "pos")
    found = first_match(requests, table, [ekey], ["page", "pos"], how="left").drop("page", "pos")
    return found.join(specs.select(F.col("idx").cast("long").alias("espec_index"), "spec"), "espec_index", "left").drop("espec_index")


def cached_ranges(requests: DataFrame, cache: DataFrame, keys: Sequence[str] = ("archive", "offset", "length")) -> DataFrame:
    """JN-46: bytes of a range that was cached under exactly this archive, offset and length; null otherwise."""
    return requests.join(cache.select(*keys, "data"), list(keys), "left")


def same_content(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """JN-48: for each pair, whether both sides have the same bytes; false if one is missing."""
    return pairs.withColumn("same", F.coalesce(F.col(a) == F.col(b), F.lit(False)))


# --- flags and filters ----------------------------------------------------------------------------------------------------


def any_flag(flags: Column, mask: int) -> Column:
    """FLT-01, 04: does a row share a bit with the mask (locales; a single flag)?"""
    return flags.bitwiseAND(F.lit(mask)) != 0


def all_flags(flags: Column, mask: int) -> Column:
    """FLT-02: has a row all bits of the mask (content)?"""
    return flags.bitwiseAND(F.lit(mask)) == mask


def fits(locale_flags: Column, content_flags: Column, locale: int, content: int) -> Column:
    """FLT-03: any of the locale's bits and all of the content's."""
    return any_flag(locale_flags, locale) & all_flags(content_flags, content)


def has_names(content_flags: Column) -> Column:
    """FLT-05: does a block keep name hashes? The bit says that it does not."""
    return ~any_flag(content_flags, 1 << 28)


def has_file(bridge: DataFrame, tag: str, files: DataFrame) -> DataFrame:
    """FLT-06: each file's number with ``in_tag``; an unknown tag holds no file."""
    hit = bridge.where(F.col("tag") == tag).select("idx").distinct().withColumn("in_tag", F.lit(True))
    return files.join(hit, "idx", "left").withColumn("in_tag", F.coalesce("in_tag", F.lit(False)))


def by_category(entries: DataFrame, category: str, eff: str = "eff") -> DataFrame:
    """FLT-16: entries of one priority category."""
    return entries.where(P.category(F.col(eff)) == category)


def in_names(tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """FLT-29: tags whose name is in the list; an empty list matches none."""
    return tags.where(F.col("tag").isin(*names)) if names else tags.where(F.lit(False))


def patches(index: DataFrame, patch: Column | None = None, source: Column | None = None, target: Column | None = None) -> DataFrame:
    """FLT-33..35: rows of a patch index by any of the three keys."""
    out = index
    for name, value in (("patch_ekey", patch), ("source_ekey", source), ("target_ekey", target)):
        out = out if value is None else out.where(F.col(name) == value)
    return out


def patches_from(entries: DataFrame, source: Column) -> DataFrame:
    """FLT-36: (target, patch) of nested entries (target_ckey, patches[source_ekey, patch_ekey, ...]) with this source."""
    flat = entries.select("target_ckey", "pos", F.explode("patches").alias("patch"))
    return flat.where(F.col("patch.source_ekey") == source)


def first_target(entries: DataFrame, target: Column) -> DataFrame:
    """FLT-37: the first entry of a target, none if there is none."""
    return entries.where(F.col("target_ckey") == target).orderBy("pos").limit(1)


def active_row(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """FLT-38: the first row, in file order, whose Active field is exactly 1 (of each document)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.where(F.col("Active").cast("string") == "1").groupBy(*keys).agg(F.min_by(F.struct(*rest), "pos").alias("r"))
    return best.where(F.col("r").isNotNull()).select(*keys, "r.*")


#: Error classes that are tried again whatever their detail.
RETRYABLE = ("network", "timeout", "failover", "unavailable", "connection_limit", "pool_exhausted", "rate_limited", "mirror_lag")


def is_retryable(kind: Column, status: Column, retry_on: Sequence[int]) -> Column:
    """FLT-48: an HTTP error by its status, any other by its class."""
    return F.coalesce(F.when(kind == "http", status.isin(*retry_on) if retry_on else F.lit(False)).otherwise(kind.isin(*RETRYABLE)), F.lit(False))


# --- projections ------------------------------------------------------------------------------------------------


def all_records(blocks: DataFrame) -> DataFrame:
    """PRJ-15: the records of nested blocks (block, locale_flags, content_flags, records), in order."""
    return blocks.select("block", "locale_flags", "content_flags", F.posexplode("records").alias("pos", "record")).select("block", "pos", "locale_flags", "content_flags", "record.*")


def region_urls(region: Column, domain: Column, port: int = 1119) -> list[Column]:
    """PRJ-22: a region's version service (https), patch service (http) and address, under its domain."""
    return [
        F.concat(F.lit("https://"), region, F.lit(".version."), domain).alias("https_url"),
        F.concat(F.lit("http://"), region, F.lit(".patch."), domain, F.lit(f":{port}")).alias("http_url"),
        F.concat(region, F.lit(".version."), domain, F.lit(f":{port}")).alias("address"),
    ]


def game_directory(config: Column) -> Column:
    """PRJ-23: the directory name that a product's configuration (JSON) gives; null if any step is missing."""
    return F.get_json_object(config, "$.all.config.form.game_dir.dirname")


def encoding_layout(spec_size: Column, ckey_pages: Column, ekey_pages: Column, kb: int = 4) -> Column:
    """PRJ-28: the layout of an encoding table as a spec: header, specs, and both indexes and page runs; empty parts are left out."""
    sizes = [(F.lit(22), "n"), (spec_size, "z"), (ckey_pages * 32, "n"), (ckey_pages * (kb * 1024), "n"), (ekey_pages * 32, "n"), (ekey_pages * (kb * 1024), "n")]
    parts = [F.when(c > 0, F.concat(c.cast("string"), F.lit(f"={mode}"))) for c, mode in sizes]
    return F.concat(F.lit("b:{"), F.concat_ws(",", *parts, F.lit("*=z")), F.lit("}"))


def patch_header_size(blocks: Column, spec: Column | None = None, key_size: int = 16) -> Column:
    """PRJ-31: bytes before the first block of a patch archive; ``spec`` is that of the extended header, if there is one."""
    extended = F.lit(0) if spec is None else F.coalesce(2 * key_size + 9 + F.octet_length(spec), F.lit(0))
    return F.lit(10) + extended + blocks * (key_size + 20)


# --- figures --------------------------------------------------------------------------------------------------------


def report(entries: DataFrame, base_priority: int = 0, eff: str = "eff", size: str = "size") -> DataFrame:
    """AGG-16: the text report on a download manifest: totals, range, shares, and a line for each category that occurs."""
    from strandline.operators.aggregates import essential_summary, priority_analysis

    total = essential_summary(entries, eff, size).crossJoin(entries.agg(F.min(eff).alias("lo"), F.max(eff).alias("hi")))
    order = F.create_map(*[x for i, c in enumerate(["Critical", "Essential", "High", "Normal", "Low"]) for x in (F.lit(c), F.lit(i))])
    line = F.format_string("  %s: %d files (%.1f%%), %s (%.1f%%)", "category", "files", "files_percent", P.human_size(F.col("bytes")), "bytes_percent")
    per = priority_analysis(entries, eff, size).agg(F.transform(F.array_sort(F.collect_list(F.struct(order[F.col("category")].alias("i"), line.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.format_string(
        "Total Files: %d\nTotal Size: %s\nPriority Range: %d to %d\nBase Priority Adjustment: %d\nEssential Content: %.1f%%\nStreamable Content: %.1f%%\nGood Streaming Potential: %s\n\nCategory Breakdown:\n",
        "files", P.human_size(F.col("bytes")), "lo", "hi", F.lit(base_priority), "essential_percent", "streamable_percent", F.when(F.col("good_streaming"), "Yes").otherwise("No"),
    )
    return total.crossJoin(per).select(F.concat(head, F.array_join("lines", "\n")).alias("report"))  # one row each


def patch_entry_count(entries: DataFrame) -> DataFrame:
    """AGG-28: files with patches, and patches."""
    return entries.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("patches")), F.lit(0)).cast("long").alias("patches"))


def root_size(root: DataFrame, version: int) -> DataFrame:
    """AGG-33: estimated bytes of a root table of this version: the header, and each block of equal flags."""
    named = root.agg((F.count("name_hash") > 0).alias("named"))
    blocks = root.groupBy("locale_flags", "content_flags").agg(F.count("*").alias("n")).crossJoin(named)
    head = {1: 0, 2: 12}.get(version, 20)
    return blocks.agg((F.coalesce(F.sum(P.root_block_size(F.col("n"), version, F.col("named"))), F.lit(0)) + head).cast("long").alias("bytes"))


def total_builds() -> Column:
    """AGG-38: builds, of all or of each product."""
    return F.count("*")


def live_entries(view: DataFrame) -> DataFrame:
    """AGG-41: entries of an index after its log, by bucket."""
    return view.groupBy("bucket").agg(F.count("*").alias("entries"))


def bootstrap_stats(servers: DataFrame, paths: DataFrame) -> DataFrame:
    """AGG-61: servers, with and without https, and paths."""
    https = F.count_if(F.col("https"))
    s = servers.agg(F.count("*").alias("total_servers"), https.alias("https_servers"), (F.count("*") - https).alias("http_servers"))
    return s.crossJoin(paths.agg(F.count("*").alias("total_paths")))


def path_cache_stats(entries: DataFrame, now: Column, ttl_seconds: int | None) -> DataFrame:
    """AGG-66: entries, and those past their time; without one nothing expires."""
    old = F.lit(0).cast("long") if ttl_seconds is None else F.count_if(F.unix_timestamp(now) - F.unix_timestamp("cached_at") > ttl_seconds)
    return entries.agg(F.count("*").alias("total_entries"), (F.count("*") - old).alias("valid_entries"), old.alias("expired_entries"))


def compaction_totals(archives: DataFrame, threshold: float = 0.3) -> DataFrame:
    """AGG-68: of archives (size, used, entries) that are wasted beyond the threshold: how many, bytes reclaimed, entries moved."""
    waste = F.col("size") - F.col("used")
    hit = archives.where((F.col("size") > 0) & (waste / F.col("size") > threshold))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return hit.agg(F.count("*").alias("archives_compacted"), zero(waste).alias("bytes_reclaimed"), zero("entries").alias("entries_moved"))


def mean_validation_time(runs: DataFrame, ns: str = "ns") -> DataFrame:
    """AGG-69: mean nanoseconds of a validation, in integer division; 0 without any."""
    n = F.count("*")
    return runs.agg(n.alias("n"), F.when(n > 0, F.expr(f"sum({ns}) div count(*)")).otherwise(F.lit(0)).cast("long").alias("mean_ns"))


def recovery_stats(attempts: DataFrame) -> DataFrame:
    """AGG-71: of attempts (retry, ok, failover, ms): retries and their success, failovers, errors and mean time; no retry counts as success."""
    retries, good = F.count_if("retry"), F.count_if(F.col("retry") & F.col("ok"))
    n, errors = F.count("*"), F.count_if(~F.col("ok"))
    return attempts.agg(
        retries.alias("retry_total"), good.alias("retry_successful"), (retries - good).alias("retry_failed"), F.when(retries > 0, good / retries).otherwise(1.0).alias("retry_success_rate"),
        F.count_if("failover").alias("failover_count"), errors.alias("error_count"), n.alias("total_requests"), F.when(n > 0, errors / n).otherwise(0.0).alias("error_rate"), F.coalesce(F.avg("ms"), F.lit(0.0)).alias("avg_ms"),
    )


# --- orders of the writers ---------------------------------------------------------------------------------------


def in_key_order(entries: DataFrame, key: str, doc: Sequence[str] = ()) -> DataFrame:
    """ORD-01, 14, 15: rows as a writer of sorted files wants them: a file's rows in one range of tasks, by its key."""
    by = [*doc, key]
    return entries.repartitionByRange(*by).sortWithinPartitions(*by)


# --- caches as tables --------------------------------------------------------------------------------------------


def store_with_ttl(rows: DataFrame, now: Column, ttl_seconds: int | None) -> DataFrame:
    """SNK-28: rows as a cache table keeps them: with the time they were stored, and when they expire (null: never)."""
    until = F.lit(None).cast("timestamp") if ttl_seconds is None else F.timestamp_seconds(F.unix_timestamp(now) + ttl_seconds)
    return rows.withColumn("stored_at", now).withColumn("expires_at", until)


def cache_get(requests: DataFrame, cache: DataFrame, key: str, now: Column) -> DataFrame:
    """STR-10: the newest valid entry of each requested key; null columns on a miss."""
    valid = not_expired(cache, now)
    rest = [c for c in valid.columns if c != key]
    newest = valid.groupBy(key).agg(F.max_by(F.struct(*rest), "stored_at").alias("r")).select(key, "r.*")
    return requests.join(newest, key, "left")


def lru_cycle(entries: DataFrame, size_limit: int, mean_size: int, order: Sequence[str]) -> DataFrame:
    """STR-07: one maintenance run: loaded entries, evicted ones and their bytes at the mean size, and what stays active."""
    n = entries.count()
    over = n * mean_size - size_limit if size_limit > 0 and mean_size > 0 else 0
    gone = evict_to_target(entries, max(0, over), mean_size, order)
    return gone.agg(F.lit(n).cast("long").alias("loaded_entries"), F.count("*").alias("entries_evicted"), (F.count("*") * mean_size).cast("long").alias("bytes_freed"), (F.lit(n) - F.count("*")).cast("long").alias("active_entries"))


def newest_indexes(files: DataFrame, name: str = "name") -> DataFrame:
    """SRC-35: of index files named ``bbvvvvvvvv.idx`` (hex bucket and version), the one of the highest version of each bucket; other names are ignored."""
    rx = r"(?:^|/)([0-9a-fA-F]{2})([0-9a-fA-F]{8})\.idx$"
    part = lambda i: F.conv(F.regexp_extract(name, rx, i), 16, 10).cast("long")
    found = files.where(F.col(name).rlike(rx)).withColumn("bucket", part(1)).withColumn("version", part(2))
    return found.groupBy("bucket").agg(F.max_by(name, "version").alias(name), F.max("version").alias("version"))
