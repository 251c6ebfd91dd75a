"""The remaining registered queries: text documents as tables, responses, mutations, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import ranges as R
from strandline.operators import aggregates as A
from strandline.operators import extension as X
from strandline.operators import folds as W
from strandline.operators import lookups as J
from strandline.operators import merges as M
from strandline.operators import topk as O
from strandline.plans.catalog import query, table
from strandline.sources import text as TX


@query("SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def resolve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-25..27 over the whole table."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return J.resolve_all(li, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"])


@query("SELECT n_nationkey, upper(n_name) AS key_id, r_name AS key_value FROM nation LEFT JOIN (SELECT min(n_regionkey) AS k, lower(n_name) AS id FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 2) ON lower(n_name) = id LEFT JOIN region ON k = r_regionkey")
def key_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-37: keys by id without regard to case."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    keys = n.where("n_nationkey % 2 = 0").join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("key_id"), F.col("r_name").alias("key_value"), F.col("n_nationkey").alias("pos"))
    return J.key_by_id(n.select("n_nationkey", F.upper("n_name").alias("key_id")), keys)


@query("""
SELECT s_suppkey AS id, n_name AS path, s_nationkey AS vfs_offset, r_regionkey AS encoded_size FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT n_nationkey AS k, n_regionkey AS c FROM nation WHERE n_nationkey % 4 <> 0) ON s_nationkey = k LEFT JOIN region ON c = r_regionkey
""")
def vfs_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-30, 31: path -> first span -> container, by offsets; paths without spans are kept."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    paths = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("path"), F.col("s_nationkey").alias("vfs_offset"))
    spans = n.select(F.col("n_nationkey").alias("offset"), F.when(F.col("n_nationkey") % 4 != 0, F.array(F.struct(F.col("n_regionkey").alias("cft_offset")), F.struct(F.lit(-1).alias("cft_offset")))).otherwise(F.array().cast("array<struct<cft_offset:int>>")).alias("spans"))
    boxes = r.select(F.col("r_regionkey").alias("offset"), F.col("r_name").alias("ekey"), F.col("r_regionkey").alias("encoded_size"))
    return J.vfs_resolve(paths, spans, boxes).select("id", "path", "vfs_offset", "encoded_size")


@query("""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 3 THEN -1 WHEN o_orderkey % 7 = 0 THEN o_custkey * 2 ELSE o_custkey END AS v FROM orders WHERE o_orderkey % 10 <> 5
UNION ALL SELECT 10000000 + o_orderkey AS k, 1 AS v FROM orders WHERE o_orderkey % 50 = 1
""")
def log_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-08..11, 18, 29; STR-18: appends, updates, status changes and tombstones at the end of a log, then its view."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("long").alias("v"))
    log = spark.createDataFrame([], "k long, v long, seq long, status string")
    pos = F.col("k").alias("pos")
    log = M.append_log(log, base.where("k % 50 = 1").select((F.col("k") + 10_000_000).alias("k"), F.lit(1).cast("long").alias("v"), pos), "Normal")
    log = M.append_log(log, base.where("k % 7 = 0").select("k", (F.col("v") * 2).alias("v"), pos), "Normal")
    log = M.append_log(log, base.where("k % 10 = 3").select("k", F.lit(-1).cast("long").alias("v"), pos), "Normal")
    log = M.append_log(log, base.where("k % 10 = 5").select("k", "v", pos), "Delete")
    return M.log_view(base, log, ["k"])


@query("SELECT event_type, count(*) AS n, avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY event_type HAVING count(*) >= 10 AND avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) < 0.5 AND max(ts) FILTER (WHERE event_id % 3 <> 0) >= TIMESTAMP '2024-01-01 00:00:00'")
def circuit_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-19."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", (F.col("event_id") % 3 == 0).alias("ok"))
    return W.should_break(e, ["event_type"], "ok", "ts", F.lit("2024-01-01 00:01:00").cast("timestamp_ntz")).select("event_type", "n", "rate")


@query("WITH s AS (SELECT s_suppkey, 1.0 + s_nationkey AS score, sum(1.0 + s_nationkey) OVER (ORDER BY s_suppkey) AS u, sum(1.0 + s_nationkey) OVER () AS t FROM supplier) SELECT s_suppkey FROM s WHERE u > t * 0.37 ORDER BY s_suppkey LIMIT 1")
def weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-18 with a fixed draw."""
    return W.weighted_pick(table(spark, sf_dir, "supplier").select("s_suppkey", (1.0 + F.col("s_nationkey")).alias("score")), "score", 0.37, "s_suppkey").select("s_suppkey")


@query("""
SELECT n_nationkey AS id, list_filter([CASE WHEN n_nationkey % 2 = 0 THEN 'enUS' END, CASE WHEN n_nationkey % 3 = 0 THEN 'deDE' END, CASE WHEN n_nationkey % 5 = 0 THEN 'frFR' END], lambda x: x IS NOT NULL) AS locales,
  CASE WHEN n_nationkey % 4 = 0 THEN CAST('inf' AS DOUBLE) ELSE 100.0 / (n_nationkey % 4) END AS efficiency FROM nation
""")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-58, AGG-62."""
    k = F.col("n_nationkey")
    names = [(F.when(k % m == 0, F.lit(1)), n) for m, n in ((2, "enUS"), (3, "deDE"), (5, "frFR"))]
    return table(spark, sf_dir, "nation").select(k.alias("id"), A.available(names).alias("locales"), A.efficiency(F.lit(100.0), k % 4).alias("efficiency"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false WHEN event_id % 4 = 1 THEN false ELSE true END AS ok FROM events")
def content_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-43: headers that answer a request, and others."""
    i = F.col("event_id")
    h = F.when(i % 4 == 0, F.lit("bytes */10")).when(i % 4 == 1, F.format_string("bytes %d-%d/*", i, i + 5)).otherwise(F.format_string("bytes %d-%d/999999", i, i + 9))
    return table(spark, sf_dir, "events").select("event_id", R.content_range_ok(h, i, F.lit(10)).alias("ok"))


@query("""
WITH m AS (SELECT n_nationkey, 'Content-Type: multipart/alternative; boundary="strandline"' || chr(13) || chr(10) || chr(13) || chr(10) || '--strandline' || chr(13) || chr(10) || 'Content-Type: text/plain' || chr(13) || chr(10) || chr(13) || chr(10) || n_name || chr(13) || chr(10) || '--strandline--' || chr(13) || chr(10) AS t FROM nation)
SELECT n_nationkey, sha256(t) AS digest, true AS valid FROM m
""")
def mime_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-27, SRC-49, 66: wrapped, parsed and checked."""
    m = table(spark, sf_dir, "nation").select("n_nationkey", TX.mime_wrap(F.col("n_name")).alias("m"))
    p = TX.mime_parts(F.col("m"))
    return m.select("n_nationkey", F.regexp_extract("m", "Checksum: ([0-9a-f]{64})", 1).alias("digest"), p["valid"].alias("valid"))


@query("SELECT replace(r_name, ' ', '_') || '.example' AS host, n_name AS path, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY r_regionkey) * 10 AS INT) AS priority FROM nation, region WHERE contains(n_name, 'A')")
def server_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-50: hosts of the rows whose name contains a product, with priorities 10, 20, ..."""
    r = table(spark, sf_dir, "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: F.concat(F.translate(x["r_name"], " ", "_"), F.lit(".example"))), " ").alias("Hosts"))
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("Name"), F.col("n_name").alias("Path")).crossJoin(F.broadcast(r))
    return TX.server_table(n, "A").select("host", "path", "priority")


def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as the entries of a document's keys."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("doc"), F.col("c_custkey").alias("k"))
    names = c.select("doc", F.lit("archives").alias("key"), "k", F.col("k").cast("string").alias("value"))
    sizes = c.select("doc", F.lit("archives-index-size").alias("key"), "k", F.when(F.col("k") % 5 == 0, "bad").otherwise((F.col("k") * 3).cast("string")).alias("value"))
    from pyspark.sql import Window

    both = names.unionByName(sizes)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("doc", "key").orderBy("k")) - 1).drop("k")


@query("""
WITH a AS (SELECT 'n' || c_nationkey AS doc, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
s AS (SELECT doc, k * 3 AS size, row_number() OVER (PARTITION BY doc ORDER BY k) - 1 AS i FROM a WHERE k % 5 <> 0)
SELECT a.doc, CAST(a.i AS INT) AS i, CAST(a.k AS VARCHAR) AS name, CAST(s.size AS BIGINT) AS size FROM a LEFT JOIN s ON a.doc = s.doc AND a.i = s.i
""")
def config_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, 08, 59: names zipped with sizes, after unparsable sizes are dropped."""
    return TX.archives(_config(spark, sf_dir)).select("doc", F.col("i").cast("int").alias("i"), "name", "size")


@query("""
WITH d AS (SELECT DISTINCT o_custkey AS doc, CAST(o_orderkey % 12 AS INT) AS n FROM orders), k AS (SELECT doc, n, row_number() OVER (PARTITION BY doc ORDER BY n) AS r FROM d WHERE n > 0)
SELECT CAST(doc AS VARCHAR) AS doc, n FROM k WHERE n = r
""")
def numbered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: entries 1, 2, ... up to the first gap."""
    kv = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc"), F.concat(F.lit("vfs-"), (F.col("o_orderkey") % 12).cast("string")).alias("key"), F.lit("x").alias("value"), F.lit(0).alias("pos")).distinct()
    return TX.numbered_entries(kv).select("doc", "n")


@query("SELECT event_id, value > 30 AND user_id % 3 <> 1 OR user_id % 3 = 1 OR value > 90 AS gone FROM events WHERE value IS NOT NULL")
def invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-40: by number, memory or time."""
    v, u = F.col("value"), F.col("user_id")
    gone = X.must_invalidate(F.when(u % 3 == 1, F.lit(1)).otherwise(F.lit(9)), F.lit(5), F.when(u % 3 == 1, F.lit(0.0)).otherwise(v), 30, v, 90)
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", gone.alias("gone"))


@query("SELECT p_partkey, p_size >= 3 AS after, p_size * 60.0 / p_partkey >= 1.0 AS often, p_size >= 1 AND p_partkey <= 300 AS young, (p_size > 0 AND p_partkey * 20000 > 1048576 AND p_size * 100000 < p_partkey * 20000 * 0.7) AS compact FROM part")
def cache_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-57, FLT-58."""
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", X.promote("after", s, k).alias("after"), X.promote("frequency", s, k).alias("often"), X.promote("age", s, k).alias("young"), X.needs_compaction(s * 100000, k * 20000).alias("compact"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 8 = 0")
def zero_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-46: padding records found by their zeros."""
    z = F.col("o_orderkey") % 8
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(z == 0, F.lit(bytes(16))).otherwise(F.unhex(F.md5(F.col("o_orderkey").cast("string")))).alias("key"), z.alias("size"), z.alias("offset"))
    return o.where(X.is_zero(F.col("key"), F.col("size"), F.col("offset"))).select("o_orderkey")


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 'md5,not_empty' WHEN doc_id % 6 = 0 THEN 'md5' ELSE '' END AS failed FROM documents WHERE text IS NOT NULL")
def validation_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-05, VAL-10, 23: hooks by name and what each row fails."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    key = F.when((F.col("doc_id") % 6 == 0) | (F.col("text") == ""), F.unhex(F.md5(F.lit("other")))).otherwise(F.unhex(F.md5("text")))
    return X.validate_with(d.select("doc_id", F.encode("text", "utf-8").alias("content"), key.alias("key")), ["md5", "not_empty"]).select("doc_id", F.array_join("failed", ",").alias("failed"))


@query("SELECT o_orderkey, o_orderpriority AS priority, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS INT) AS place FROM orders")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-13, STR-15: a queue's order for each customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"))
    return O.top_k(o, ["o_custkey"], [F.col("priority"), F.col("created_at"), F.col("id")], 1 << 30).select(F.col("id").alias("o_orderkey"), "priority", F.col("rank").alias("place"))


@query("""
WITH RECURSIVE r AS (SELECT user_id, s, e, row_number() OVER (PARTITION BY user_id ORDER BY s, e) AS k FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + event_id % 900 AS e FROM events)),
f AS (
  SELECT user_id, k, s AS a, e AS b, 1 AS g FROM r WHERE k = 1
  UNION ALL
  SELECT user_id, k, CASE WHEN fits THEN a ELSE s END, CASE WHEN fits THEN greatest(b, e) ELSE e END, g + CASE WHEN fits THEN 0 ELSE 1 END
  FROM (SELECT r.user_id, r.k, r.s, r.e, f.a, f.b, f.g, r.s <= f.b + 601 AND greatest(f.b, r.e) - f.a + 1 <= 3600 AS fits FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
)
SELECT user_id, min(a) AS start, max(b) AS "end" FROM f GROUP BY user_id, g
""")
def capped_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09: greedy ranges of at most an hour for each user."""
    s = F.unix_timestamp("ts")
    r = table(spark, sf_dir, "events").select("user_id", s.alias("start"), (s + F.col("event_id") % 900).alias("end"))
    return W.coalesce_capped(r, ["user_id"], 600, 3600)


@query("""
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice % 1000 + 1) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
f AS (
  SELECT o_custkey, o_orderkey, size, k, CAST(0 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS segment_offset, [size] AS used FROM o WHERE k = 1
  UNION ALL
  SELECT o_custkey, o_orderkey, size, k, CAST(p - 1 AS BIGINT), coalesce(used[p], 0), CASE WHEN p > len(used) THEN list_append(used, size) ELSE list_concat(list_concat(used[1:p - 1], [used[p] + size]), used[p + 1:]) END
  FROM (SELECT o.*, f.used, coalesce(nullif(list_position(list_transform(f.used, lambda u: u + o.size <= 2000), true), 0), len(f.used) + 1) AS p FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.k = f.k + 1)
)
SELECT o_custkey, o_orderkey, size, segment, segment_offset FROM f
""")
def first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-20: orders of each customer placed in segments, first fit."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") % 1000 + 1).cast("long").alias("size"))
    return W.allocate(o, ["o_custkey"], ["o_orderkey"], "size", 2000)


@query()
def segment_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-20: which sparse segments of a nation's customers move where."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("group"), F.col("c_custkey").alias("segment"), (F.abs(F.floor("c_acctbal")) % 1000).cast("long").alias("used"), F.lit(1000).cast("long").alias("size"))
    return M.merge_plan(c, 0.5, 1000)
