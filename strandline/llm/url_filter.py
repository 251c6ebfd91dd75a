"""URL filters: a blocked Bloom filter over listed canonical URLs before an exact hash join.

A rule is a host with a path prefix (``example.org/es/``) and a verdict. It fits a URL whose host is the
rule's or a subdomain and whose path starts with the rule's; the longest rule wins. Each URL spells its
possible rule texts: every suffix of its host joined to every prefix of its path that is as long as some
listed path. The filter, a row of bytes beside the scan in which a probe reads one block, rejects almost all of
them there; what it passes meets the list in an exact hash join, which removes the false positives. Everything is
DataFrame operations.

Edge cases: a null URL or one without ``://`` has an empty host and path and gets the default verdict; a
rule with a null or empty host never fits; listed twice, ``block`` wins over ``allow``; of rules of the same length
the one with the longer host wins; an empty list gives the default verdict everywhere; repeated rows stay
repeated rows. Extra columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block, bits set for an entry, and entries a block is meant for.
BLOCK_BITS, SET_BITS, PER_BLOCK = 64, 5, 4
#: A filter of at most so many blocks (8 bytes each) or a list of so many rows is broadcast; beyond, both are shuffled by key.
MAX_BROADCAST_BLOCKS, MAX_BROADCAST_RULES = 1 << 18, 200_000


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(_lower(host), F.lit(""))


def canonical_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _mask(key: Column) -> Column:
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    out = F.lit(0).cast("long")
    for i in range(SET_BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")))
    return out


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(n_blocks))


def build_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter as rows ``(block, word)``: one 64-bit word for each block that is not empty."""
    return keys.select(_block(F.col(key), n_blocks).alias("block"), _mask(F.col(key)).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def _as_bytes(bloom: DataFrame, n_blocks: int) -> bytes:
    """The whole filter, 8 bytes a block."""
    empty = bloom.sparkSession.range(n_blocks).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("word"))
    words = bloom.unionByName(empty).groupBy("block").agg(F.bit_or("word").alias("word"))
    digits = F.sort_array(F.collect_list(F.struct("block", F.lpad(F.hex("word"), 16, "0").alias("digits"))))
    return bytes(words.agg(F.unhex(F.array_join(F.transform(digits, lambda x: x["digits"]), "")).alias("b")).first()["b"])


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    ``rules(host, path, verdict)`` has verdicts ``allow`` and ``block``. Columns of ``pages`` with the
    names of the new ones are replaced. Of the list only its size, the set of its paths' lengths and the
    filter (2 MB at most) come to the driver.
    """
    listed = rules.where("host is not null and host <> ''").select(_lower(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
    listed = listed.select(F.concat("h", "p").alias("rule"), F.length("h").alias("host_length"), F.length("p").alias("n"), "verdict")
    size = listed.agg(F.count("*").alias("rows"), F.sort_array(F.collect_set("n")).alias("lengths")).first()
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in new]
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("page"), canonical_host(F.col(url)).alias("host"), canonical_path(F.col(url)).alias("path"))
    if not size["rows"]:
        return base.select("page.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    listed = listed.groupBy("rule").agg(F.max("verdict").alias("rule_verdict"), F.max("host_length").alias("host_length"))
    n_blocks = 1 << max(4, (size["rows"] // PER_BLOCK).bit_length())

    labels = F.split("host", r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in size["lengths"]]), lambda n: n <= F.length("path"))
    prefixes = F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))
    # no candidate at all for a URL without a host, so that "" never meets a rule
    candidates = F.when(F.col("host") != "", F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))).otherwise(F.array().cast("array<string>"))

    bloom = build_filter(listed, "rule", n_blocks)
    row = F.struct("page", "host", "path")
    keyed = base.withColumn("row", F.monotonically_increasing_id())
    if n_blocks <= MAX_BROADCAST_BLOCKS:
        # a constant of the plan, beside every URL without a shuffle; a probe reads its block's 8 bytes
        filter_ = F.lit(bytearray(_as_bytes(bloom, n_blocks)))

        def passes(k: Column) -> Column:
            word = F.conv(F.hex(F.substring(filter_, (_block(k, n_blocks) * 8 + 1).cast("int"), F.lit(8))), 16, -10).cast("long")
            return word.bitwiseAND(_mask(k)) == _mask(k)

        probed = keyed.withColumn("hits", F.filter(candidates, passes))
        hit = probed.where(F.size("hits") > 0).select("row", row.alias("whole"), F.explode("hits").alias("key"))
        miss = probed.where(F.size("hits") == 0).select("page.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    else:
        keys = keyed.select("row", row.alias("whole"), F.explode_outer(candidates).alias("key")).withColumn("block", _block(F.col("key"), n_blocks))
        hit = keys.join(bloom, "block", "left").select("row", "whole", F.when(F.col("word").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")), F.col("key")).alias("key"))
        miss = None
    if size["rows"] <= MAX_BROADCAST_RULES:
        listed = F.broadcast(listed)
    longest = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "host_length", "rule"))
    found = hit.join(listed, hit["key"] == listed["rule"], "left").groupBy("row").agg(F.first("whole").alias("w"), longest.alias("r"))
    found = found.select("w.page.*", "w.host", "w.path", F.col("r.rule").alias("rule"), F.coalesce("r.rule_verdict", F.lit(default)).alias("verdict"))
    return found if miss is None else found.unionByName(miss)
