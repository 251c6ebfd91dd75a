"""Registered queries over chunk containers, deltas, local blobs, archives and the remaining lookups."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline.functions import chunks as C
from strandline.functions import priority as P
from strandline.functions.specs import unpack_by_spec
from strandline.operators import aggregates as A
from strandline.operators import extension as X
from strandline.operators import lookups as J
from strandline.operators import merges as M
from strandline.operators import topk as O
from strandline.plans.catalog import query, table
from strandline.plans.session import spread, work_folder
from strandline.sources import storage as S
from strandline.sources import text as T

_KEY_ID, _KEY, _IV = 0xFA505078126ACB3E, bytes(range(16)), b"\1\2\3\4"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))


def _by_document(d: DataFrame, cols: list[str], figures: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows of figures about each document. Blobs are made and read one at a time and do not leave the worker."""
    kind = to_arrow_schema(StructType.fromDDL(f"doc_id long, {schema}"))

    def run(batches):
        for b in batches:
            rows = [(doc, *r) for doc, *values in zip(b["doc_id"], *(b[c] for c in cols), strict=True) for doc in (doc.as_py(),) for r in figures(*(v.as_py() for v in values))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(kind), kind, strict=True)], schema=kind)

    return d.select("doc_id", *[c for c in cols if c != "doc_id"]).mapInArrow(run, f"doc_id long, {schema}")


def _packed(raw: bytes, doc: int) -> bytes:
    """Containers of all kinds in turn: stored, packed, and encrypted with either cipher."""
    cipher = {2: "salsa20", 3: "arc4"}.get(doc % 4)
    encrypt = None if cipher is None else lambda packed, i: C.encrypt_chunk(packed, _KEY_ID, _KEY, _IV, i, cipher)
    return C.build_container(raw, 1 << 12, ("stored", "zlib", "lz4", "zlib")[doc % 4], encrypt)


_N = "d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents)"


@query(f"WITH {_N} SELECT doc_id, CAST(i AS INTEGER) AS idx, ['N', 'Z', 'E', 'E'][doc_id % 4 + 1] AS mode, CAST(least(4096, n - 4096 * i) AS BIGINT) AS decompressed_size, true AS same FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(n / 4096) AS BIGINT)))) AS i FROM d)")
def chunk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-16, 17, 39; SRC-32, 33; SCL-22..26: every document in a container, stored, packed or encrypted; its chunk table, and whether the content came back."""

    def figures(raw: bytes, doc: int) -> list[tuple]:
        blob = _packed(raw, doc)
        same = C.read_container(blob, {_KEY_ID: _KEY}) == raw
        return [(c["idx"], c["mode"], c["decompressed_size"], same) for c in C.list_chunks(blob)]

    return _by_document(_texts(spark, sf_dir), ["raw", "doc_id"], figures, "idx int, mode string, decompressed_size long, same boolean")


@query(f"WITH {_N} SELECT doc_id, CAST(i AS INTEGER) AS idx, CAST(least(4096, n - 4096 * i) AS BIGINT) AS size FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(n / 4096) AS BIGINT)))) AS i FROM d) WHERE i BETWEEN 1 AND 2")
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-65: a run of chunks by number."""
    chunks = _texts(spark, sf_dir).select("doc_id", F.explode(C.chunks_column(C.container_column(F.col("raw"), 1 << 12))).alias("c")).select("doc_id", "c.*")
    return X.chunk_range(chunks, 1, 2).select("doc_id", "idx", F.col("decompressed_size").alias("size"))


@query("SELECT p_partkey AS id, m AS method, md5(repeat(p_name, 5) || p_partkey || repeat(p_name, 3)) AS digest, true AS same FROM part, (VALUES ('simple'), ('chunked'), ('suffix')) AS v(m)")
def delta_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-36..38; SRC-34, 58; SCL-27..30; VAL-22; STR-05: patches by all three methods, applied."""
    name = F.col("p_name")
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 5000)
    p = p.select(F.col("p_partkey").alias("id"), F.encode(F.repeat(name, 6), "utf-8").alias("old"), F.encode(F.concat(F.repeat(name, 5), F.col("p_partkey").cast("string"), F.repeat(name, 3)), "utf-8").alias("new"))
    got = [F.struct(F.lit(m).alias("method"), C.apply_delta_column(F.col("old"), C.delta_column(F.col("old"), F.col("new"), m)).alias("got")) for m in ("simple", "chunked", "suffix")]
    out = p.select("id", "new", F.explode(F.array(*got)).alias("r")).select("id", "new", "r.*")
    return out.select("id", "method", F.md5("got").alias("digest"), (F.col("got") == F.col("new")).alias("same"))


def _by_spec(name: str, i: int) -> str:
    """A name packed by one of three specs, and unpacked again."""
    import hashlib
    import zlib

    raw = name.encode("utf-8")
    data, spec = ((raw * 4, "n"), (zlib.compress(raw * 4), "z"), (raw + zlib.compress(raw * 3), f"b:{{{len(raw)}=n,*=z}}"))[i % 3]
    return hashlib.md5(unpack_by_spec(data, spec)).hexdigest()


@query("SELECT p_partkey AS id, md5(repeat(p_name, 4)) AS digest FROM part")
def spec_unpacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-45, 44: patch data unpacked by its spec: plain, deflated, and in blocks."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C._each("string", _by_spec)(F.col("p_name"), F.col("p_partkey")).alias("digest"))


@query("SELECT p_partkey AS id, 1 AS steps, 0 AS match_bytes, octet_length(encode(p_name)) AS extra_bytes, octet_length(encode(p_name)) AS size, 0.0 AS match_percent, 0.0 AS mean_seek FROM part")
def delta_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-36, 64: figures of patches that are all extra bytes."""
    new = F.encode("p_name", "utf-8")
    stats = C.delta_stats_column(C.delta_column(F.lit(b"old"), new, "simple"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), stats.alias("s")).select("id", "s.*")


@query(f"WITH {_N} SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS ekey, n + 30 AS size, true AS valid, true AS bare, true AS packed FROM d")
def local_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-20, 40; SRC-40..42; SCL-40: blobs behind their local header, bare or in a container."""

    def figures(raw: bytes, key: bytes) -> list[tuple]:
        blob, box = (S.build_local_header(key, len(x), 5) + x for x in (raw, C.build_container(raw)))
        h = S.parse_local_header(blob, 5)
        return [(h["ekey"].hex(), h["size"], h["valid"], S.read_local_content(blob)[30:] == raw, S.read_local_content(box) == raw)]

    d = _texts(spark, sf_dir).withColumn("ekey", F.unhex(F.md5(F.col("doc_id").cast("string"))))
    return _by_document(d, ["raw", "ekey"], figures, "ekey string, size long, valid boolean, bare boolean, packed boolean")


@query(f"WITH {_N} SELECT doc_id, hex(array_slice(raw, doc_id % 50 + 1, doc_id % 50 + 8)) AS data, least(8, greatest(0, n - doc_id % 50)) = 8 AS resident FROM d")
def archive_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-25, 39, 51..53, 62, 64; JN-35, 49: ranges out of archives by index; whether the archive reaches that far."""
    d = _texts(spark, sf_dir)
    index = d.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("doc"), (F.col("doc_id") % 50).alias("offset"), F.lit(8).cast("long").alias("size"))
    asked = J.group_requests(d.select(F.col("doc_id").alias("key")), index, "key", "doc", "offset", "size")
    got = X.read_resident(asked, d.select(F.col("doc_id").alias("doc"), F.col("raw").alias("content")))
    return got.select(F.col("doc").alias("doc_id"), F.hex("data").alias("data"), "resident")


# --- lookups -------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey < 5")
def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-04, 05, 07, 12..16, 20, 42, 44: every row of a table with a requested key."""
    asked = table(spark, sf_dir, "customer").where("c_nationkey < 5").select("c_custkey")
    return J.all_matches(asked, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), ["c_custkey"])


@query("SELECT c_custkey AS pos, c_custkey * 2 AS o_orderkey, coalesce(o_orderstatus, 'none') AS o_orderstatus FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 2")
def probes_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11, 28: one row a request, with a value for misses."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") * 2).alias("o_orderkey"))
    return J.batch_probe(asked, table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", miss=F.lit("none"))


@query("SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey")
def first_odd_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-43: the first row in file order that passes a condition."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return J.first_match(o.select("o_custkey").distinct(), o, ["o_custkey"], ["o_orderkey"], F.col("o_orderkey") % 2 == 1)


@query("SELECT 'all' AS how, p_partkey AS idx FROM part WHERE p_partkey % 2 = 0 AND p_size % 3 = 0 UNION ALL SELECT 'any', p_partkey FROM part WHERE p_partkey % 2 = 0 OR p_size % 3 = 0 UNION ALL SELECT 'empty', p_partkey FROM part")
def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07, 13..15: files of a platform and an architecture, of either, and of an empty list of tags."""
    p = table(spark, sf_dir, "part")
    bridge = p.select(F.col("p_partkey").alias("idx"), F.explode(F.array(F.when(F.col("p_partkey") % 2 == 0, "Windows").otherwise("Mac"), F.when(F.col("p_size") % 3 == 0, "x86").otherwise("arm64"))).alias("tag"))
    files = p.select(F.col("p_partkey").alias("idx"))
    got = [("all", J.in_all_tags(files, bridge, ["Windows", "x86"])), ("any", J.in_any_tag(files, bridge, ["Windows", "x86", "unknown"])), ("empty", J.in_all_tags(files, bridge, [], empty_means_all=True))]
    out = None
    for name, df in got:
        part = df.select(F.lit(name).alias("how"), "idx")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id, md5(text) AS key FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0")
def valid_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-45; VAL-12, 24: rows whose bytes have the digest that their key says; every fifth is damaged."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("data"), F.unhex(F.md5("text")).alias("key"))
    return J.validated(d, "data", "key").select("doc_id", F.lower(F.hex("key")).alias("key"))


# --- text documents ------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS id, 'install' AS type, 2 AS n_keys, s_suppkey * 3 AS size FROM supplier")
def patch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-34, SRC-10, FLT-32: patch configuration lines."""
    s = table(spark, sf_dir, "supplier")
    k = lambda salt: F.md5(F.concat(F.lit(salt), F.col("s_suppkey").cast("string")))
    path = work_folder(spark, "patches")
    s.select(F.concat_ws(" ", F.lit("patch-entry = install"), k("a"), (F.col("s_suppkey") * 3).cast("string"), k("b"), F.col("s_suppkey").cast("string")).alias("line")).write.text(path)
    e = T.read_patch_entries(spark, path)
    return e.select(F.col("sizes")[1].alias("id"), "type", F.size("keys").alias("n_keys"), F.col("sizes")[0].alias("size"))


@query("SELECT n_nationkey AS doc, md5('c' || n_nationkey) AS ckey, CASE WHEN n_nationkey % 2 = 0 THEN md5('e' || n_nationkey) END AS ekey, CAST(n_nationkey * 10 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS encoded_size FROM nation")
def config_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-60: pairs of keys of an entry; a missing second one is null."""
    n = table(spark, sf_dir, "nation")
    k = lambda salt: F.md5(F.concat(F.lit(salt), F.col("n_nationkey").cast("string")))
    keys = F.when(F.col("n_nationkey") % 2 == 0, F.array(k("c"), k("e"))).otherwise(F.array(k("c")))
    kv = n.select(F.col("n_nationkey").alias("doc"), F.lit("install").alias("key"), F.posexplode(keys).alias("pos", "value"))
    kv = kv.unionByName(n.select(F.col("n_nationkey").alias("doc"), F.lit("install-size").alias("key"), F.lit(0).alias("pos"), (F.col("n_nationkey") * 10).cast("string").alias("value")))
    return T.key_pairs(kv, "install")


@query("SELECT n_nationkey AS doc, n_name AS entry, CAST(n_regionkey - 2 AS INTEGER) AS priority FROM nation")
def partial_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: pairs of a name and a priority; malformed ones are passed over."""
    kv = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"), F.lit("build-partial-priority").alias("key"), F.concat(F.col("n_name"), F.lit(":"), (F.col("n_regionkey") - 2).cast("string"), F.lit(",broken,x:y,:3")).alias("value"))
    return T.partial_priorities(kv)


@query("SELECT n_nationkey AS doc, CASE WHEN n_nationkey % 3 = 1 THEN 'encoding' ELSE 'install,encoding' END AS missing FROM nation WHERE n_nationkey % 3 > 0")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-05, 06, 08, 09: documents with the required names that they lack."""
    names = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("root"), F.lit("install"), F.lit("encoding"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("root"), F.lit("install"))).otherwise(F.array(F.lit("root")))
    kv = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"), F.explode(names).alias("key"))
    return T.required_keys(kv, ["root", "install", "encoding"]).select("doc", F.array_join("missing", ",").alias("missing"))


@query("SELECT h AS host, 'data' AS path, CAST(p AS INTEGER) AS priority FROM (VALUES ('a.example.net', 10), ('b.example.net', 20)) AS v(h, p)")
def fallback_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-67: the fixed list, in order."""
    return T.fallback_servers(spark, ["a.example.net", "b.example.net"], "data")


# --- projections, orders, sets ----------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, CASE WHEN c = 'Critical' THEN -128 WHEN c = 'Essential' THEN 0 WHEN c = 'High' THEN 1 WHEN c = 'Normal' THEN 3 ELSE 6 END AS low, CASE WHEN c = 'Critical' THEN -1 WHEN c = 'Essential' THEN 0 WHEN c = 'High' THEN 2 WHEN c = 'Normal' THEN 5 ELSE 127 END AS high, p_name AS name FROM (SELECT *, CASE WHEN p_size - 5 < 0 THEN 'Critical' WHEN p_size - 5 = 0 THEN 'Essential' WHEN p_size - 5 <= 2 THEN 'High' WHEN p_size - 5 <= 5 THEN 'Normal' ELSE 'Low' END AS c FROM part)")
def category_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-03, 05, 12, 13: each part's category with its bounds; its name by way of a row map."""
    p = table(spark, sf_dir, "part").withColumn("category", P.category(F.col("p_size") - 5)).withColumn("row", X.row_map(["p_partkey", "p_name"]))
    joined = p.join(F.broadcast(P.category_table(spark)), "category")  # a fixed table of five rows
    return joined.select(F.col("p_partkey").alias("id"), "low", "high", F.col("row")["p_name"].alias("name"))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'w' WHEN 2 THEN 'w' END AS config FROM nation")
def platform_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-16: a platform's configuration by any of its names."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("MacOS", "win", "Windows", "linux")]), F.col("n_nationkey") % 4 + 1)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), P.platform_config(name, F.lit("m"), F.lit("w")).alias("config"))


@query("SELECT 'expired' AS what, event_id AS id FROM events WHERE event_id % 10 <= 5 UNION ALL SELECT 'valid', event_id FROM events WHERE event_id % 10 > 5 UNION ALL SELECT 'newest', max(event_id) FROM events")
def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-11, 17; FLT-39, 56; SET-32: entries past their time and those still valid; the file of the highest generation."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 10).alias("expires_at"), F.col("event_id").alias("generation"))
    parts = [("expired", O.expired(e, F.lit(5))), ("valid", M.not_expired(e, F.lit(5))), ("newest", O.latest_generation(e))]
    out = None
    for name, df in parts:
        part = df.select(F.lit(name).alias("what"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT DISTINCT p_partkey AS idx, t AS tag FROM part, (VALUES ('a'), ('b')) AS v(t) WHERE t = 'a' OR p_partkey % 2 = 0")
def associated_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-15, 30; SNK-42: tags added to files, without repeats."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"))
    return M.associate(p.withColumn("tag", F.lit("a")), p.where("idx % 2 = 0").select("idx", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("tag")))


@query("SELECT count(*) / 60.0 AS ops_per_second FROM events")
def operations_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-52: events a second of a window."""
    return A.throughput(table(spark, sf_dir, "events"), 60.0)


@query("SELECT user_id, CAST(sum(event_id % 100) AS BIGINT) AS total, CAST(sum(event_id % 100) AS BIGINT) = 500 AS valid FROM events GROUP BY user_id HAVING user_id = (SELECT min(user_id) FROM events)")
def stated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-34, 35; VAL-01, 02: does a stated total agree?"""
    e = table(spark, sf_dir, "events")
    u = e.agg(F.min("user_id")).first()[0]
    return A.check_total(e.where(F.col("user_id") == u).select((F.col("event_id") % 100).alias("esize")), 500).select(F.lit(u).alias("user_id"), "total", "valid")

