"""More registered queries: filters, aggregates, windows, set operations, checks and streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import keys as K
from strandline.functions import paths as PA
from strandline.functions import priority as P
from strandline.functions import ranges as R
from strandline.functions import specs as S
from strandline.operators import aggregates as A
from strandline.operators import folds as W
from strandline.operators import lookups as J
from strandline.operators import merges as M
from strandline.operators import tables as TB
from strandline.operators import topk as O
from strandline.plans.catalog import query, table
from strandline.plans.session import spread
from strandline.streaming import state as ST

_KINDS = ("Platform", "Architecture", "Locale", "Category", "Unknown", "Component", "Version", "Optimization", "Region", "Device", "Mode", "Branch", "Content", "Feature", "Expansion", "Alternate", "Option")
_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), F.element_at(kinds, (F.col("p_size") % 17 + 1).cast("int")).alias("tag_type"))


@query(f"""
WITH t AS (SELECT p_partkey, p_brand AS name, {_KIND_LIST}[CAST(p_size % 17 + 1 AS INT)] AS tag_type FROM part)
SELECT p_partkey, tag_type, tag_type IN ('Platform', 'Architecture', 'Device') AS platform_specific, tag_type IN ('Option', 'Alternate', 'Expansion', 'Content') AS optional,
  tag_type IN ('Platform', 'Architecture', 'Component', 'Category') AS required, tag_type IN ('Content', 'Feature', 'Expansion', 'Option', 'Alternate') AS streamable,
  tag_type IN ('Locale', 'Region') AS locale_specific, tag_type IN ('Platform', 'Architecture', 'Locale', 'Feature', 'Component', 'Region') AS affects_streaming,
  tag_type IN ('Feature', 'Content', 'Expansion') AS feature_content,
  CASE tag_type WHEN 'Platform' THEN name = 'Brand#11' WHEN 'Architecture' THEN name = 'Brand#12' ELSE true END AS fits_platform,
  CASE tag_type WHEN 'Locale' THEN name = 'Brand#13' WHEN 'Region' THEN name = 'Brand#14' ELSE true END AS fits_locale
FROM t
""")
def tag_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-22..28, 49..51, 53."""
    t, n = F.col("tag_type"), F.col("name")
    classes = ("platform_specific", "optional", "required", "streamable", "locale_specific", "affects_streaming", "feature_content")
    return _tagged(spark, sf_dir).select(
        "p_partkey", "tag_type", *[P.in_class(t, c).alias(c) for c in classes], P.tag_matches_platform(t, n, "Brand#11", "Brand#12").alias("fits_platform"), P.tag_matches_locale(t, n, "Brand#13", "Brand#14").alias("fits_locale")
    )


@query(f"""
WITH t AS (SELECT {_KIND_LIST}[CAST(p_size % 17 + 1 AS INT)] AS tag_type FROM part)
SELECT count(*) AS total_tags, count(*) FILTER (WHERE tag_type IN ('Platform', 'Architecture', 'Device')) AS platform_specific, count(*) FILTER (WHERE tag_type IN ('Locale', 'Region')) AS locale_specific,
  count(*) FILTER (WHERE tag_type IN ('Option', 'Alternate', 'Expansion', 'Content')) AS optional, count(*) FILTER (WHERE tag_type IN ('Platform', 'Architecture', 'Component', 'Category')) AS required,
  count(*) FILTER (WHERE tag_type IN ('Content', 'Feature', 'Expansion', 'Option', 'Alternate')) AS streamable FROM t
""")
def tag_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25, 26; FLT-30, 31."""
    return A.tag_analysis(_tagged(spark, sf_dir))


@query(f"""
SELECT CAST(w.weight AS INT) AS weight, count(*) AS n FROM part JOIN (SELECT unnest({_KIND_LIST}) AS k, unnest([1, 2, 5, 4, 4, 3, 8, 12, 6, 9, 10, 11, 13, 7, 14, 15, 16]) AS weight) w ON {_KIND_LIST}[CAST(p_size % 17 + 1 AS INT)] = w.k GROUP BY 1
""")
def tag_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-26: weights from the dimension table, whose size is fixed."""
    return _tagged(spark, sf_dir).join(F.broadcast(P.tag_type_table(spark)), "tag_type").groupBy("weight").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, (o_orderkey & 12) <> 0 AS any_bit, (o_orderkey & 5) = 5 AS all_bits, (o_orderkey & 8) <> 0 AS one, (o_orderkey & 268435456) = 0 AS named,
  (o_orderkey & 12) <> 0 AND (o_orderkey & 5) = 5 AS both FROM orders
""")
def flag_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01..05."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", TB.any_flag(k, 12).alias("any_bit"), TB.all_flags(k, 5).alias("all_bits"), TB.any_flag(k, 8).alias("one"), TB.has_names(k).alias("named"), TB.fits(k, k, 12, 5).alias("both"))


@query("""
WITH r AS (SELECT event_id, CAST(event_id * 10 AS BIGINT) AS s, CAST(event_id * 10 + user_id % 25 AS BIGINT) AS e FROM events)
SELECT event_id, e - s + 1 AS n, s <= 500 AND 300 <= e AS hit, e + 1 = 300 OR 501 = s AS touch, greatest(0, greatest(s, 300) - least(e, 500) - 1) AS gap, s <= e AND e < 4000 AS inside, least(s, 300) AS m_start, greatest(e, 500) AS m_end FROM r
""")
def range_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-31, 32; SET-23; VAL-15."""
    r = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 10).alias("s"), (F.col("event_id") * 10 + F.col("user_id") % 25).alias("e"))
    s, e, a, b = F.col("s"), F.col("e"), F.lit(300).cast("long"), F.lit(500).cast("long")
    m = R.merged(s, e, a, b)
    return r.select("event_id", R.length(s, e).alias("n"), R.overlaps(s, e, a, b).alias("hit"), R.adjacent(s, e, a, b).alias("touch"), R.gap(s, e, a, b).alias("gap"), R.inside(s, e, F.lit(4000)).alias("inside"), m["start"].alias("m_start"), m["end"].alias("m_end"))


@query("""
SELECT user_id, 'bytes=' || string_agg(s || '-' || e, ', ' ORDER BY s, e) AS header FROM (SELECT user_id, event_id * 10 AS s, event_id * 10 + 5 AS e FROM events) GROUP BY user_id
""")
def range_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-29 over the whole table."""
    r = table(spark, sf_dir, "events").select("user_id", F.struct((F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 5).alias("end")).alias("r"))
    return r.groupBy("user_id").agg(R.header_value(F.array_sort(F.collect_list("r"))).alias("header"))


@query("""
SELECT o_orderkey, CAST(k AS BIGINT) AS packed, CAST(o_orderkey % 1000 AS INT) AS archive, CAST(o_custkey AS BIGINT) AS off FROM (SELECT *, (o_orderkey % 1000) * 4294967296 + o_custkey AS k FROM orders)
""")
def packed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-17, PRJ-18."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", P.pack_offset(F.col("o_orderkey") % 1000, F.col("o_custkey")).alias("packed"))
    u = P.unpack_offset(F.col("packed"))
    return o.select("o_orderkey", "packed", u["archive"].alias("archive"), u["offset"].alias("off"))


@query("""
SELECT page_id, substr(d, 1, 2) || '/' || substr(d, 3, 2) || '/' || substr(d, 5) AS path, 'http://h.example/base/data/' || substr(d, 1, 2) || '/' || substr(d, 3, 2) || '/' || d AS delivery, 'config:' || d AS cache_key FROM (SELECT page_id, md5(url) AS d FROM pages)
""")
def delivery_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-19..21, 24, 30."""
    d = F.md5("url")
    return table(spark, sf_dir, "pages").select("page_id", PA.content_path(d).alias("path"), PA.delivery_url(F.lit("h.example"), F.lit("/base/"), F.lit("data"), F.upper(d)).alias("delivery"), PA.cache_key("config", F.lit(None).cast("string"), d).alias("cache_key"))


@query("SELECT o_custkey, max_by(struct_pack(k := o_orderkey, p := o_totalprice), o_orderkey).p AS price FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 0) GROUP BY o_custkey")
def location_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-17, SET-12, SET-31: the last of several indexes wins."""
    o = table(spark, sf_dir, "orders")
    both = o.where("o_orderkey % 2 = 0").unionByName(o.where("o_orderkey % 3 = 0"))
    return J.build_location_map(both, "o_custkey", ["o_orderkey"], ["o_totalprice"]).withColumnRenamed("o_totalprice", "price")


@query("""
WITH u AS (SELECT o_custkey AS k, 0 AS src, o_orderkey AS pos, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, 1, o_orderkey, o_totalprice FROM orders)
SELECT k, src, pos, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, pos) AS r FROM u) WHERE r = 1
""")
def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01, 02, 28: equal keys keep the lowest source and position."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("src"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("v"))
    first = o.where("pos % 2 = 0").withColumn("src", F.lit(0))
    return M.merge_first(first.unionByName(o), ["k"], ["src", "pos"])


@query("""
WITH gone AS (SELECT n_nationkey AS idx FROM nation WHERE n_nationkey % 7 = 3)
SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS idx, n_name AS path FROM nation WHERE n_nationkey NOT IN (SELECT idx FROM gone)
""")
def remove_and_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-13."""
    f = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("path"))
    return M.remove_and_renumber(f, f.select("idx"), f.where("idx % 7 = 3"))[0]


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 0")
def update_and_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-14, 16, 17, 25."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    changed = M.update_values(p, p.where("p_partkey % 4 = 0").withColumn("p_size", F.col("p_partkey")), ["p_partkey"], "p_size")
    return M.without(changed, p.where("p_partkey % 5 = 0"), ["p_partkey"])


@query("""
WITH p AS (SELECT n_name AS host, n_nationkey AS priority FROM nation WHERE n_nationkey < 10), f AS (SELECT n_name AS host, n_nationkey AS priority FROM nation WHERE n_nationkey BETWEEN 5 AND 15)
SELECT host, priority FROM p UNION ALL SELECT host, CAST(priority + (SELECT max(priority) + 100 FROM p) AS INT) FROM f WHERE host NOT IN (SELECT host FROM p)
""")
def merge_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-19."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("host"), F.col("n_nationkey").alias("priority"))
    return M.merge_servers(n.where("priority < 10"), n.where("priority between 5 and 15"))


@query("SELECT o_orderkey FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) NOT IN (SELECT substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) FROM orders WHERE o_orderkey <= 40)")
def remove_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-22: keys removed by their common prefix with short ones."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.unhex(F.md5(F.col("o_orderkey").cast("string"))).alias("key"))
    short = o.where("o_orderkey <= 40").select(F.substring("key", 1, 1).alias("key"))
    return M.without_prefix(o, short, "key").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem EXCEPT SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey % 2 = 0")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-14, 26: rows whose keys are not among others."""
    cols = ("l_orderkey", "l_linenumber", "l_partkey")
    li = spread(table(spark, sf_dir, "lineitem").select(*cols, "l_suppkey"), cols, 1_000_000)  # a task sorts that many, however many there are
    even = li.where("l_suppkey % 2 = 0").select(*cols)
    return M.without(li.select(*cols).distinct(), even, cols)


@query("SELECT user_id, event_id, max(v) OVER w AS peak, avg(v) OVER w AS mean FROM (SELECT *, CAST(floor(value * 1000) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03."""
    e = table(spark, sf_dir, "events").withColumn("v", F.floor(F.col("value") * 1000).cast("long"))
    return W.running_stats(e, ["user_id"], ["ts", "event_id"], "v").select("user_id", "event_id", "peak", "mean")


@query("""
SELECT event_id, CAST(CASE WHEN value <= 0 THEN 1048576 ELSE greatest(65536, least(33554432, CAST(trunc(value * 50000 * 2) AS BIGINT))) END AS BIGINT) AS size,
  CAST(CASE WHEN value * 500000 < 1048576 THEN 4096 WHEN value * 500000 < 5242880 THEN 8192 WHEN value * 500000 < 20971520 THEN 16384 ELSE 24576 END AS BIGINT) AS gap FROM events WHERE value IS NOT NULL
""")
def adaptive_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04, WIN-10."""
    v = F.col("value")
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", W.recommended_size(v * 50000, 2.0).alias("size"), W.dynamic_gap(8192, v * 500000).alias("gap"))


@query("""
WITH s AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS off, 1 + event_id % 5000 AS size FROM events),
f AS (SELECT *, max(off + size) OVER (PARTITION BY user_id ORDER BY off, size, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s)
SELECT user_id, count(*) AS n FROM f WHERE e > off GROUP BY user_id
""")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11."""
    s = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("offset"), (1 + F.col("event_id") % 5000).alias("size"))
    return W.overlapping_spans(s, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p > o_totalprice")
def unsorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12, 13, 16: with the real position of each break."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return W.unsorted_rows(o, ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM orders")
def append_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12, WIN-20, SET-21."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("size"))
    return W.with_offsets(o, ["o_custkey"], ["o_orderkey"], "size", "off").select("o_custkey", "o_orderkey", "off")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-21."""
    return W.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def last_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-22."""
    return W.last_rows(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@query("""
WITH g AS (SELECT event_type, list(CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY ts, event_id) AS a, avg(user_id) AS m FROM events GROUP BY event_type)
SELECT event_type, round(list_reduce(list_prepend(0.0::DOUBLE, a), lambda acc, x: acc * 0.9 + x * 0.1), 6) AS hit_rate, CAST(len(a) AS BIGINT) AS n, round(m, 6) AS mean_size FROM g
""")
def access_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06, WIN-07."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", (F.col("event_id") % 3 == 0).alias("hit"), "user_id")
    a = W.access_patterns(e, ["event_type"], ["ts", "event_id"], "hit", "user_id")
    return a.select("event_type", F.round("hit_rate", 6).alias("hit_rate"), "n", F.round("mean_size", 6).alias("mean_size"))


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7")
def evict_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-12: ceil(640 / 100) entries."""
    return O.evict_to_target(table(spark, sf_dir, "customer"), 640, 100, ["c_acctbal", "c_custkey"]).select("c_custkey")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 2 = 0 ORDER BY s_nationkey, s_suppkey LIMIT 1")
def primary_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-16."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_nationkey").alias("priority"), F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") % 2 == 0).alias("https"))
    return O.primary_server(s).select("s_suppkey", "s_nationkey")


@query("SELECT o_custkey, o_orderkey, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-07..09 per group: three orders a customer."""
    return O.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT DISTINCT lower(regexp_extract(url, '\\.([a-z]+)$', 1)) AS ext FROM pages WHERE regexp_matches(url, '\\.[a-z]+$') AND contains(regexp_extract(url, '[^\\\\/]*$'), '.')")
def extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, 27, 37; FLT-12."""
    e = F.lower(PA.extension(F.col("url")))
    return A.distinct_sorted(table(spark, sf_dir, "pages"), F.when(e.rlike("^[a-z]+$"), e), "ext")


@query("SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, round(avg(n_chars), 6) AS mean_bytes, count(*) FILTER (WHERE n_chars > 4294967295) AS large_files, round(count(*) FILTER (WHERE n_chars > 4294967295) * 100.0 / count(*), 6) AS large_percent FROM documents")
def size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18..20, 23, 24, 35, 42."""
    s = A.size_stats(table(spark, sf_dir, "documents"), "n_chars")
    return s.select("files", "bytes", F.round("mean_bytes", 6).alias("mean_bytes"), "large_files", F.round("large_percent", 6).alias("large_percent"))


@query("SELECT count(*) AS files, count(nullif(o_custkey % 3, 0)) AS named, count(DISTINCT o_custkey) AS ids, count(DISTINCT nullif(o_custkey % 3, 0)) AS names FROM orders")
def root_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29..31, 45."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fdid"), F.nullif(F.col("o_custkey") % 3, F.lit(0)).alias("name_hash"))
    return A.root_stats(o)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-32."""
    return A.block_stats(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""
SELECT event_type, round(avg(CASE WHEN event_id % 4 <> 0 THEN 1.0 ELSE 0.0 END), 9) AS success_rate, avg(CAST(floor(value * 1000) AS BIGINT)) / 1000 AS mean_ms, count(*) AS n,
  CASE WHEN avg(CASE WHEN event_id % 4 <> 0 THEN 1.0 ELSE 0.0 END) >= 0.9 THEN 'Fair' WHEN avg(CASE WHEN event_id % 4 <> 0 THEN 1.0 ELSE 0.0 END) >= 0.7 THEN 'Poor' ELSE 'Critical' END AS condition FROM events GROUP BY event_type
""")
def network_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-55, 57, 60, 65."""
    e = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 1000).cast("long").alias("value"), (F.col("event_id") % 4 != 0).alias("ok"))
    n = A.network_condition(e, "ok", "value", ["event_type"])
    return n.select("event_type", F.round("success_rate", 9).alias("success_rate"), (F.col("mean_ms") / 1000).alias("mean_ms"), "n", "condition")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 10 <> 0) AS valid, count(*) FILTER (WHERE doc_id % 10 = 0) AS invalid FROM documents WHERE text IS NOT NULL")
def verify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-43, 44; JN-45, VAL-10..12: content against an external key, damaged on purpose for every tenth row."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("text", K.content_key(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("key"))
    return A.verify_content(d, "text", "key")


@query("SELECT bucket, count(*) AS entries FROM (SELECT o_orderkey % 16 AS bucket FROM orders UNION ALL SELECT l_orderkey % 16 FROM lineitem) GROUP BY bucket")
def raw_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-39, 40: repeats included."""
    return A.raw_bucket_counts(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 16).alias("bucket")), table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 16).alias("bucket")))


@query("""
WITH a AS (SELECT event_id, CAST(event_id % 6 AS INT) AS attempt, ['Excellent', 'Good', 'Fair', 'Poor', 'Critical'][CAST(user_id % 5 + 1 AS INT)] AS c FROM events)
SELECT event_id, round(CASE WHEN attempt = 0 THEN 0.0 ELSE least(1000.0, 100.0 * pow(2.0, attempt - 1)) * CASE c WHEN 'Excellent' THEN 0.5 WHEN 'Good' THEN 0.8 WHEN 'Fair' THEN 1.0 WHEN 'Poor' THEN 1.5 ELSE 2.0 END END, 6) AS delay FROM a
""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-36."""
    c = F.element_at(F.array(*[F.lit(x) for x in ("Excellent", "Good", "Fair", "Poor", "Critical")]), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.round(R.retry_delay((F.col("event_id") % 6).cast("int"), 100.0, 1000.0, c), 6).alias("delay"))


@query("""
WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'data.' || lpad(CAST(p_partkey % 1200 AS VARCHAR), 4, '0') WHEN p_partkey % 3 = 1 THEN 'data.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') ELSE 'index.' || p_partkey END AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(name, '^data\\.[0-9]{3,4}$') AND CAST(regexp_extract(name, '[0-9]+') AS INT) < 1023 THEN CAST(regexp_extract(name, '[0-9]+') AS INT) END AS segment,
  lpad(lower(printf('%x', p_partkey)), 16, '0') || '.lru' AS lru_name, p_partkey AS back FROM f
""".replace("\\\\", "\\"))
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-38, SCL-39."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("data."), F.lpad((k % 1200).cast("string"), 4, "0"))).when(k % 3 == 1, F.concat(F.lit("data."), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("index."), k.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", PA.data_file_segment(name).alias("segment"), PA.generation_name(k).alias("lru_name"), PA.name_generation(PA.generation_name(k)).alias("back"))


@query("""
SELECT item_id, list_filter(range(1, length(t) + 1), lambda p: substr(t, p, 2) = 'an') AS hits, CASE WHEN contains(t, 'an') THEN CAST(instr(t, 'an') - 1 AS INT) END AS first
FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark)
""")
def find_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-33, STR-13: overlapping positions of a byte pattern (here 1-based, to compare)."""
    t = F.encode(F.regexp_replace("text", "[^ -~]", ""), "utf-8")
    b = table(spark, sf_dir, "benchmark").select("item_id", t.alias("t"))
    return b.select("item_id", F.transform(K.find_all_bytes(F.col("t"), b"an"), lambda p: (p + 1).cast("long")).alias("hits"), K.find_bytes(F.col("t"), b"an").alias("first"))


@query("SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 300 WHEN 'view' THEN 60 ELSE 900 END + CAST(floor(epoch(ts)) AS BIGINT) AS until FROM events")
def unavailable_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14: windows by error class."""
    err = F.when(F.col("event_type") == "click", "timeout").when(F.col("event_type") == "view", "rate_limited").otherwise("server_error")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp(ST.unavailable_until(err, F.col("ts"))).alias("until"))


@query("SELECT user_id % 4 AS bucket, user_id AS k, arg_max(event_type, event_id) AS update_type, arg_max(event_type, event_id) NOT IN ('click') AS resident FROM events GROUP BY user_id")
def residency_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16..18, FLT-42."""
    t = F.when(F.col("event_type") == "click", "Delete").otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("bucket"), F.col("user_id").alias("ekey"), F.col("event_id").alias("seq"), t.alias("update_type"), F.lit(None).cast("string").alias("span"))
    v = ST.residency_view(e)
    return v.select("bucket", F.col("ekey").alias("k"), F.when(F.col("update_type") == "Delete", "click").otherwise(F.col("update_type")).alias("update_type"), "resident")


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows, as a batch."""
    return ST.windowed_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n")


@query()
def lru_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06: an LRU cache of 8 users for each event type, over the whole log."""
    kinds = F.pmod(F.xxhash64("event_type"), F.lit(1 << 20))
    e = table(spark, sf_dir, "events").select(kinds.alias("cache_id"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"))
    return ST.lru_batch(e, 8)


@query("""
SELECT p_partkey, 'BlockTable' AS spec_kind, true AS compressed, path, CASE k WHEN 0 THEN 'BlockTable' WHEN 1 THEN CASE WHEN p_size % 3 = 1 THEN 'None' ELSE 'ZLib' END ELSE 'ZLib' END AS kind,
  CASE WHEN k = 1 THEN CAST(p_size AS BIGINT) * 1024 END AS size, CASE WHEN k = 1 THEN CAST(1 AS BIGINT) END AS count, CASE WHEN k = 1 AND p_size % 3 = 2 THEN 9 END AS level,
  CASE WHEN k = 1 AND p_size % 3 = 2 THEN 'mpq' END AS variant, CAST(NULL AS INTEGER) AS bits, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS iv
FROM part, (VALUES (0, '0'), (1, '0.0'), (2, '0.1')) AS n(k, path)
""")
def spec_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-19..21, FLT-43..45: specs made from part names and sizes, parsed."""
    spec = F.concat(F.lit("b:{"), F.col("p_size").cast("string"), F.lit("K="), F.when(F.col("p_size") % 3 == 0, "z").when(F.col("p_size") % 3 == 1, "n").otherwise("z:{9,mpq}"), F.lit(",*=z}"))
    n = table(spark, sf_dir, "part").select("p_partkey", S.nodes_column(spec).alias("nodes"), S.kind(spec).alias("kind"))
    return n.select("p_partkey", F.col("kind").alias("spec_kind"), S.is_compressed(F.col("nodes")).alias("compressed"), F.explode("nodes").alias("node")).select("p_partkey", "spec_kind", "compressed", "node.*")


@query()
def container_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-16, SRC-32, SCL-22, 23: every document packed in chunks and unpacked; ``same`` says whether it came back."""
    from strandline.functions import chunks as C

    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "utf-8").alias("raw"))
    packed = d.withColumn("blob", C.container_column(F.col("raw"), 1 << 12))
    return packed.select("doc_id", F.octet_length("blob").alias("n"), (C.content_column(F.col("blob")) == F.col("raw")).alias("same"))
