"""Registered queries over the given tables, with the SQL that gives the same rows.

Each query applies operators of this library to ``region .. conversations``; its oracle is written for DuckDB
and shares no code with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import keys as K
from strandline.functions import paths as PA
from strandline.functions import priority as P
from strandline.operators import aggregates as A
from strandline.operators import folds as W
from strandline.operators import lookups as J
from strandline.operators import merges as M
from strandline.operators import topk as O
from strandline.plans.session import small_batches

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    import strandline.plans.catalog_formats
    import strandline.plans.catalog_more
    import strandline.plans.catalog_rest
    import strandline.plans.catalog_store  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import strandline.plans.catalog_formats
    import strandline.plans.catalog_more
    import strandline.plans.catalog_rest
    import strandline.plans.catalog_store  # noqa: F401

    return dict(_ORACLES)


_FOLD = " ".join(f"xor(('0x' || substr(k, {2 * i + 1}, 2))::INT," for i in range(8)) + " ('0x' || substr(k, 17, 2))::INT" + ")" * 8


@query(f"""
WITH d AS (SELECT doc_id, text, md5(text) AS k FROM documents WHERE text IS NOT NULL),
f AS (SELECT k, min(doc_id) AS doc_id, any_value(strlen(text)) AS n FROM d GROUP BY k),
b AS (SELECT n, {_FOLD} AS x FROM f)
SELECT CAST(xor(x & 15, x >> 4) AS INT) AS bucket, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_bytes FROM b GROUP BY 1
""")
def content_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-04, SCL-07, SET-01, AGG-40: documents deduplicated by content key, with keys and bytes per bucket."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", K.content_key(F.col("text")).alias("key"), F.octet_length("text").alias("n"))
    first = M.merge_first(d, ["key"], ["doc_id"])
    return first.groupBy(K.bucket(F.col("key")).alias("bucket")).agg(F.count("*").alias("n_keys"), F.sum("n").cast("long").alias("n_bytes"))


@query(f"""
WITH d AS (SELECT doc_id, md5(text) AS k FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, k, {_FOLD} AS x FROM d)
SELECT doc_id, k AS content_key, CAST(xor(x & 15, x >> 4) AS INT) AS bucket, CAST((xor(x >> 4, x) + 1) & 15 AS INT) AS bucket1,
       substr(k, 1, 18) AS short_key, CAST(('0x' || substr(md5(unhex(k)), 1, 4))::INT AS INT) AS archive FROM b
""")
def bucket_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-05..08, SET-03."""
    key = K.content_key(F.col("text"))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", key.alias("key"))
    return d.select("doc_id", K.key_to_hex(F.col("key")).alias("content_key"), K.bucket(F.col("key")).alias("bucket"), K.bucket_seeded(F.col("key"), 1).alias("bucket1"), K.key_to_hex(K.short_key(F.col("key"))).alias("short_key"), K.archive_number(F.col("key")).alias("archive"))


@query(r"""
SELECT page_id, regexp_extract(url, '[^\\/]*$') AS name,
  CASE WHEN regexp_matches(url, '[\\/]') THEN regexp_extract(url, '(?s)^(.*)[\\/][^\\/]*$', 1) END AS dir,
  CASE WHEN contains(regexp_extract(url, '[^\\/]*$'), '.') THEN regexp_extract(regexp_extract(url, '[^\\/]*$'), '\.([^.]*)$', 1) END AS ext,
  replace(url, '\', '/') AS norm
FROM pages
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08..11."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", PA.file_name(u).alias("name"), PA.directory(u).alias("dir"), PA.extension(u).alias("ext"), PA.normalized(u).alias("norm"))


@query("""
SELECT p_partkey, (starts_with(lower(p_name), 'part') AND ends_with(lower(p_name), '7')) AS both_ends, contains(lower(p_name), '12') AS inside, contains(lower(p_name), 'a*b*c') AS literal
FROM part
""")
def pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, FLT-11."""
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", PA.matches_pattern(n, "Part*7").alias("both_ends"), PA.matches_pattern(n, "*12*").alias("inside"), PA.matches_pattern(n, "a*B*c").alias("literal"))


@query(r"""
SELECT r_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey AS BIGINT) END AS number, lower(hex(encode(n_name))) AS raw, n_nationkey
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, SCL-18, VAL-18: lines with typed fields, parsed; an empty field is null."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    num = F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).otherwise(F.col("n_nationkey").cast("string"))
    lines = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.concat_ws("|", "r_name", num, F.hex("n_name")).alias("line"))
    f = F.split("line", r"\|", -1)
    return lines.where(F.size(f) == 3).select(K.typed_value(f[0], "STRING").alias("name"), K.typed_value(f[1], "DEC").alias("number"), K.key_to_hex(K.typed_value(f[2], "HEX")).alias("raw"), "n_nationkey")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idx"), (F.col("p_size") % 14 - 4).cast("int").alias("priority"), F.floor(F.col("p_retailprice") * 1000).cast("long").alias("size"), F.col("p_brand").alias("tag"), P.effective((F.col("p_size") % 14 - 4), 2, 3).alias("eff")
    )


_PRICED = "WITH p AS (SELECT p_partkey AS idx, p_size % 14 - 4 AS priority, CAST(floor(p_retailprice * 1000) AS BIGINT) AS size, p_brand AS tag, greatest(-128, least(127, p_size % 14 - 6)) AS eff FROM part), c AS (SELECT *, CASE WHEN eff < 0 THEN 'Critical' WHEN eff = 0 THEN 'Essential' WHEN eff <= 2 THEN 'High' WHEN eff <= 5 THEN 'Normal' ELSE 'Low' END AS category FROM p)"


@query(_PRICED + """
SELECT category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(min(eff) AS INT) AS min_priority, CAST(max(eff) AS INT) AS max_priority,
  round(avg(size), 4) AS avg_bytes, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS files_percent, round(sum(size) * 100.0 / sum(sum(size)) OVER (), 6) AS bytes_percent,
  CAST(CASE category WHEN 'Critical' THEN 1 WHEN 'Essential' THEN 2 WHEN 'High' THEN 3 WHEN 'Normal' THEN 4 ELSE 5 END AS INT) AS weight
FROM c GROUP BY category
""")
def priority_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, 02, 04; AGG-06..08, 13..15; FLT-47."""
    a = A.priority_analysis(_priced(spark, sf_dir))
    return a.select("category", "files", "bytes", "min_priority", "max_priority", F.round("avg_bytes", 4).alias("avg_bytes"), F.round("files_percent", 6).alias("files_percent"), F.round("bytes_percent", 6).alias("bytes_percent"), "weight")


@query(_PRICED + """
SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) FILTER (WHERE eff <= 0) AS BIGINT) AS essential_bytes,
  round(sum(size) FILTER (WHERE eff <= 0) * 100.0 / sum(size), 6) AS essential_percent, round(sum(size) FILTER (WHERE eff <= 0) / 1048576.0 / 10.0, 6) AS seconds
FROM c
""")
def essential_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09..12, 22, 23."""
    s = A.essential_summary(_priced(spark, sf_dir))
    return s.select("files", "bytes", "essential_bytes", F.round("essential_percent", 6).alias("essential_percent"), F.round("seconds_to_playable", 6).alias("seconds"))


@query(_PRICED + " SELECT idx, CAST(eff AS INT) AS eff, category, size, CAST(row_number() OVER (ORDER BY eff, idx) AS BIGINT) AS place FROM c WHERE eff <= 3 AND category IN ('Critical', 'Essential', 'Normal')")
def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-02..05. Places come from counts of runs, not from one global window."""
    plan = O.download_plan(_priced(spark, sf_dir), 3, ["Critical", "Essential", "Normal"]).select("idx", "eff", "category", "size")
    return O.with_place(plan).select("idx", "eff", "category", "size", "place")


@query(_PRICED + " SELECT category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM c WHERE eff <= 0 GROUP BY category")
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-03, AGG-17."""
    return O.plan_totals(O.download_plan(_priced(spark, sf_dir), 0))


@query(_PRICED + """
SELECT idx, CAST(eff + 128 AS INT) AS rank, eff <= 1 AS high, eff <= 0 AS essential, eff < 0 AS critical, eff BETWEEN -1 AND 4 AS in_range, size > 4294967295 AS large,
  CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B'
       WHEN size < 1048576 THEN (CASE WHEN size % 1024 = 0 THEN format('{:.0f}', size / 1024.0) ELSE format('{:.1f}', size / 1024.0) END) || ' KB'
       ELSE (CASE WHEN size % 1048576 = 0 THEN format('{:.0f}', size / 1048576.0) ELSE format('{:.1f}', size / 1048576.0) END) || ' MB' END AS human,
  CAST(22 + CASE WHEN idx % 2 = 0 THEN 4 ELSE 0 END + idx % 3 AS BIGINT) AS entry_bytes
FROM c
""")
def priority_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06, PRJ-07, FLT-17..21, SCL-16."""
    e = F.col("eff")
    return _priced(spark, sf_dir).select(
        "idx", P.rank(e).alias("rank"), P.is_high(e).alias("high"), P.is_essential(e).alias("essential"), P.is_critical(e).alias("critical"), e.between(-1, 4).alias("in_range"), P.is_large(F.col("size")).alias("large"), P.human_size(F.col("size")).alias("human"),
        P.serialized_size(F.col("idx") % 2 == 0, F.col("idx") % 3).cast("long").alias("entry_bytes"),
    )


_TAGS = "WITH b AS (SELECT DISTINCT l_orderkey AS idx, l_returnflag AS tag FROM lineitem)"


def _tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.floor("o_totalprice").cast("long").alias("file_size"))
    return files, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_returnflag").alias("tag")).distinct()


@query(_TAGS + " SELECT o_orderkey AS idx, CAST(floor(o_totalprice) AS BIGINT) AS file_size FROM orders WHERE o_orderkey IN (SELECT idx FROM b WHERE tag IN ('A', 'N') GROUP BY idx HAVING count(*) = 2)")
def tags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08."""
    files, bridge = _tags(spark, sf_dir)
    return J.in_all_tags(files, bridge, ["A", "N"])


@query(_TAGS + " SELECT o_orderkey AS idx, CAST(floor(o_totalprice) AS BIGINT) AS file_size FROM orders WHERE o_orderkey IN (SELECT idx FROM b WHERE tag IN ('A', 'R', 'X'))")
def tags_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09."""
    files, bridge = _tags(spark, sf_dir)
    return J.in_any_tag(files, bridge, ["A", "R", "X"])


@query(_TAGS + " SELECT tag, count(*) AS n_files FROM b GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04."""
    return A.tag_counts(_tags(spark, sf_dir)[1])


@query(_TAGS + " SELECT (SELECT count(*) FROM orders) AS total_files, (SELECT CAST(sum(floor(o_totalprice)) AS BIGINT) FROM orders) AS total_size, (SELECT count(DISTINCT tag) FROM b) AS total_tags, (SELECT max(n) FROM (SELECT count(*) AS n FROM b GROUP BY tag)) AS tagged_files")
def install_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-03."""
    return A.install_stats(*_tags(spark, sf_dir))


@query(_TAGS + " SELECT CAST(sum(floor(o_totalprice)) AS BIGINT) AS size FROM orders WHERE o_orderkey IN (SELECT idx FROM b WHERE tag IN ('A', 'N') GROUP BY idx HAVING count(*) = 2)")
def size_for_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02, AGG-21."""
    files, bridge = _tags(spark, sf_dir)
    return J.in_all_tags(files, bridge, ["A", "N"]).agg(A.total("file_size").alias("size"))


@query(_TAGS + " SELECT idx, 'both' AS kind FROM b WHERE tag IN ('A', 'N') GROUP BY idx HAVING count(*) = 2 UNION ALL SELECT DISTINCT idx, 'either' AS kind FROM b WHERE tag IN ('A', 'N')")
def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04, SET-05, SET-27."""
    bridge = _tags(spark, sf_dir)[1]
    return M.intersect_tags(bridge, "A", "N").withColumn("kind", F.lit("both")).unionByName(M.union_tags(bridge, "A", "N").withColumn("kind", F.lit("either")))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F')
SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN o ON c_custkey = o_custkey WHERE k = 1
""")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01, JN-02: the first order of each customer, in order of date and key, that passes a flag test."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return J.first_match(c, o, ["c_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") != "F").select("c_custkey", "o_orderkey", "o_totalprice")


_REQ = "(SELECT l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber = 3 THEN -l_partkey ELSE l_partkey END AS p_partkey FROM lineitem)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_linenumber") == 3, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("p_partkey"))


@query(f"SELECT pos, p_partkey, p_brand FROM {_REQ} LEFT JOIN part USING (p_partkey)")
def batch_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-09: misses are kept."""
    return J.batch_probe(_requests(spark, sf_dir), table(spark, sf_dir, "part"), "p_partkey", "p_brand")


@query(f"SELECT pos, p_partkey, coalesce(p_brand, '') AS p_brand FROM {_REQ} LEFT JOIN part USING (p_partkey)")
def batch_probe_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10, JN-23: misses give a default."""
    return J.batch_probe(_requests(spark, sf_dir), table(spark, sf_dir, "part"), "p_partkey", "p_brand", miss=F.lit(""))


@query(f"SELECT pos, p_partkey, p_brand FROM {_REQ} JOIN part USING (p_partkey)")
def resolve_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-36: misses are absent."""
    return J.all_matches(_requests(spark, sf_dir), table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"])


@query(f"SELECT pos, p_partkey, 'hit' AS kind FROM {_REQ} r WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = r.p_partkey) UNION ALL SELECT pos, p_partkey, 'miss' AS kind FROM {_REQ} r WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = r.p_partkey)")
def key_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-28, JN-29, JN-33."""
    r, p = _requests(spark, sf_dir), table(spark, sf_dir, "part")
    return J.exists(r, p, ["p_partkey"]).select("pos", "p_partkey", F.lit("hit").alias("kind")).unionByName(J.exists(r, p, ["p_partkey"], negate=True).select("pos", "p_partkey", F.lit("miss").alias("kind")))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN -1 ELSE l_suppkey END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, s AS suppkey, s_nationkey AS nationkey, n_name AS name,
  CASE WHEN s_nationkey IS NULL THEN 'nationkey' WHEN n_name IS NULL THEN 'name' END AS missing_stage
FROM r LEFT JOIN supplier ON s = s_suppkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON s_nationkey = n_nationkey
""")
def resolve_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-21..24, 41: two lookups in a row, with the stage that failed."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 2, F.lit(-1).cast("long")).otherwise(F.col("l_suppkey")).alias("suppkey"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("nationkey"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    return J.resolve_chain(r, [(J.small(s), "suppkey", "nationkey"), (J.small(n), "nationkey", "name")])


@query(f"SELECT pos, p_partkey, p_brand, CASE WHEN p_brand IS NULL THEN NULL WHEN p_size % 2 = 0 THEN 'cache' ELSE 'source' END AS origin FROM {_REQ} LEFT JOIN part USING (p_partkey)")
def probe_then_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-38, JN-47."""
    p = table(spark, sf_dir, "part")
    return J.probe_then_fallback(_requests(spark, sf_dir), p.where("p_size % 2 = 0"), p, "p_partkey", "p_brand")


@query(f"SELECT pos, p_partkey, p_brand, CAST(CASE WHEN p_brand IS NULL THEN NULL WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 ELSE 2 END AS INT) AS layer FROM {_REQ} LEFT JOIN part USING (p_partkey)")
def layered_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-39, STR-11, STR-12."""
    p = table(spark, sf_dir, "part")
    return J.resolve_ordered(_requests(spark, sf_dir), [p.where("p_size % 3 = 0"), p.where("p_size % 3 = 1"), p], "p_partkey", "p_brand")


@query("""
WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 1 + event_id % 4000 AS e FROM events)
SELECT a.user_id, a.event_id AS r_event_id, b.event_id AS q_event_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e
""")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-32: events of a user whose spans overlap, by bins."""
    s = F.unix_timestamp("ts")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("start"), (s + 1 + F.col("event_id") % 4000).alias("end"))
    return J.overlap_join(e, e, ["user_id"], 4096).select("user_id", "r_event_id", "q_event_id")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS off FROM lineitem)
SELECT l_orderkey, l_linenumber, off, CASE WHEN off < 40 THEN 'n' WHEN off < 100 THEN 'z' ELSE 'z:9' END AS spec FROM l
""")
def offset_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-34: the block that holds an offset, the last one beyond."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    off = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w).cast("long").alias("off"))
    blocks = spark.createDataFrame([(0, 40, "n"), (1, 60, "z"), (2, 10, "z:9")], "p int, size long, spec string")
    return J.offset_lookup(off, blocks, "off", "p", "size", "spec")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01: the newest order by the text of its date, the first in file order on ties."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")
    return W.latest_per_group(o, ["o_custkey"], "day", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT event_id, CAST(floor(avg(CAST(floor(value * 1000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)) AS BIGINT) AS moving_avg FROM events")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02, WIN-24."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor(F.col("value") * 1000).cast("long").alias("v"))
    return W.moving_average(e, ["user_id"], "ts", "v", "1 hour").select("event_id", "moving_avg")


@query("""
WITH g AS (SELECT user_id, list(value ORDER BY ts, event_id) AS a FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(a, lambda acc, x: acc * 0.9 + x * 0.1), 6) AS ema, CAST(len(a) AS BIGINT) AS n FROM g
""")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05: exponential mean seeded by the first sample."""
    e = W.ema(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return e.select("user_id", F.round("ema", 6).alias("ema"), "n")


@query("""
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value AS p95, n FROM s WHERE i = least(n - 1, CAST(floor(n * 95 / 100.0 + 0.5) AS BIGINT))
""")
def p95_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-56: the value at index round(0.95 n)."""
    return A.p95(table(spark, sf_dir, "events"), ["event_type"], "value")


_SPAN = "WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + event_id % 7200 AS e FROM events), f AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM e), g AS (SELECT *, sum(CASE WHEN far IS NULL OR s - far - 1 > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM f), m AS (SELECT user_id, min(s) AS \"start\", max(e) AS \"end\" FROM g GROUP BY user_id, i)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select("user_id", s.alias("start"), (s + F.col("event_id") % 7200).alias("end"))


@query(_SPAN + ' SELECT user_id, "start", "end" FROM m')
def coalesce_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08, steps 1 and 2."""
    return W.coalesce_ranges(_spans(spark, sf_dir), ["user_id"], 600)


@query(_SPAN + ' SELECT user_id, CAST(p AS BIGINT) AS "start", least(CAST(p AS BIGINT) + 3599, "end") AS "end" FROM m, unnest(generate_series("start", "end", 3600)) AS t(p)')
def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08 step 3, SET-24."""
    return W.coalesce_ranges(_spans(spark, sf_dir), ["user_id"], 600, 3600)


@query(_SPAN + " SELECT round(1 - (SELECT count(*) FROM m) / (SELECT count(*) FROM e)::DOUBLE, 9) AS request_reduction, round((SELECT sum(e - s + 1) FROM e) / (SELECT sum(\"end\" - \"start\" + 1) FROM m)::DOUBLE, 9) AS byte_efficiency")
def coalescing_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-59."""
    s = _spans(spark, sf_dir)
    return A.coalescing_gain(s, W.coalesce_ranges(s, ["user_id"], 600)).select(F.round("request_reduction", 9).alias("request_reduction"), F.round("byte_efficiency", 9).alias("byte_efficiency"))


@query("""
WITH log AS (SELECT l_orderkey AS k, (l_linenumber * 1000000 + l_partkey) * 2 + CAST(l_linestatus = 'F' AS INT) AS seq, CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN 'Delete' ELSE 'Normal' END AS status, CAST(l_partkey AS BIGINT) AS v FROM lineitem),
u AS (SELECT o_orderkey AS k, -1 AS seq, 'Normal' AS status, CAST(o_custkey AS BIGINT) AS v FROM orders UNION ALL SELECT * FROM log)
SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM u) WHERE r = 1 AND status <> 'Delete'
""")
def lsm_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06, JN-18 over the whole table."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("long").alias("v"))
    dead = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 2 == 0)
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 2 + (F.col("l_linestatus") == "F").cast("int")).alias("seq"), F.when(dead, "Delete").otherwise("Normal").alias("status"), F.col("l_partkey").cast("long").alias("v"))
    return M.log_view(base, log, ["k"])


@query("SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS delta, o_orderkey AS back FROM orders")
def delta_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14, WIN-15: deltas, and the ids decoded from them."""
    enc = W.delta_encode(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "o_orderkey")
    return W.delta_decode(enc, ["o_custkey"], "o_orderkey", "delta", "back")


@query("""
WITH s AS (SELECT event_type, count(*) AS n, CAST(floor(avg(CAST(floor(value * 1000) AS BIGINT))) AS BIGINT) AS m, max(user_id) AS top FROM events GROUP BY event_type)
SELECT CAST(sum(n) AS BIGINT) AS n, max(top) AS top, CAST(floor(sum(m * n) / sum(n)) AS BIGINT) AS m FROM s
""")
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-47: snapshots by type, then merged."""
    v = F.floor(F.col("value") * 1000).cast("long")
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.floor(F.avg(v)).cast("long").alias("m"), F.max("user_id").alias("top"))
    return A.merge_snapshots(s, [], ["top"], "m", "n")


@query("SELECT event_type, count(*) AS gets, count(*) FILTER (WHERE event_id % 3 = 0) AS hits, round(count(*) FILTER (WHERE event_id % 3 = 0) / count(*)::DOUBLE, 9) AS hit_rate, CAST(sum(user_id) AS BIGINT) AS bytes FROM events GROUP BY event_type")
def hit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-46, 48..51, 53, 54, 70."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3 == 0).alias("was_hit"), F.col("user_id").alias("size"))
    return A.hit_stats(e, ["event_type"]).select("event_type", "gets", "hits", F.round("hit_rate", 9).alias("hit_rate"), "bytes")


@query("""
SELECT s_suppkey, round((100.0 + 1000.0 / (s_nationkey + 1) + CASE WHEN s_suppkey % 2 = 0 THEN 10 ELSE 0 END + 50.0 * 0.8 - (s_suppkey % 7) * 3.0 + 5.0 + 1.0) * pow(0.9, s_suppkey % 4), 6) AS score FROM supplier
""")
def server_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-17."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(W.server_score(F.col("s_nationkey"), k % 2 == 0, F.lit(0.8), (k % 7) * 3.0, F.lit(5.0), F.lit(1.0), k % 4), 6).alias("score"))


@query("""
WITH l AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey)
SELECT r AS region, o_custkey, o_orderkey FROM l CROSS JOIN (VALUES ('us'), ('eu'), ('cn'), ('kr'), ('tw'), ('sg'), ('xx')) t(r)
""")
def region_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-23: the latest row of each key for each of seven regions: an explode, not a join."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return o.select(F.explode(F.array(*[F.lit(r) for r in ("us", "eu", "cn", "kr", "tw", "sg", "xx")])).alias("region"), "o_custkey", "o_orderkey")


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) AS content, count(*) AS chunks FROM conversations GROUP BY conv_id")
def reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03, STR-04: chunks joined in order."""
    c = table(spark, sf_dir, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("t"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("content"), F.count("*").alias("chunks"))


_EVICT = "WITH u AS (SELECT user_id AS key, max(ts) AS last_access, min(ts) AS created, count(*) AS n_access FROM events GROUP BY user_id)"


@query(_EVICT + """
SELECT 'lru' AS policy, key FROM (SELECT key FROM u ORDER BY last_access, key LIMIT 5) UNION ALL
SELECT 'lfu' AS policy, key FROM (SELECT key FROM u ORDER BY n_access, key LIMIT 5) UNION ALL
SELECT 'fifo' AS policy, key FROM (SELECT key FROM u ORDER BY created, key LIMIT 5)
""")
def evict_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-07..09."""
    u = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_access"), F.min("ts").alias("created"), F.count("*").alias("n_access"))
    out = [O.evict(u, 5, p).select(F.lit(p).alias("policy"), "key") for p in ("lru", "lfu", "fifo")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query()
def path_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-01, SCL-02: no SQL counterpart; known values are pinned in tests."""
    from strandline.functions import hashes as H

    return table(spark, sf_dir, "pages").select("page_id", H.path_hash(F.col("url")).alias("hash"), H.hash32(F.col("url")).alias("hash32"))


