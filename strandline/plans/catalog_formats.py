"""Registered queries that write each format from the given tables, read it back, and look things up in it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import hashes as H
from strandline.functions.chunks import build_container
from strandline.operators import merges as M
from strandline.operators import tables as TB
from strandline.plans.catalog import query, table
from strandline.plans.session import work_folder
from strandline.sources import binary as B
from strandline.sources import storage as S
from strandline.sources import text as X

#: Rows of a file that a query writes.
FILE = 1000


def _key(c: Column | str, salt: str = "", n: int = 16) -> Column:
    return F.unhex(F.substring(F.md5(F.concat(F.lit(salt), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))), 1, 2 * n))


def _hex(c: str) -> Column:
    return F.lower(F.hex(c))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in files of ``FILE``, with keys."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / FILE).cast("long").alias("doc"), F.col("p_partkey").alias("id"), "p_name", F.col("p_size").cast("long").alias("s"))
    return p.withColumn("ckey", _key("id", "c")).withColumn("ekey", _key("id", "e")).withColumn("ekey9", _key("id", "e", 9))


#: The same in SQL.
_PARTS = "p AS (SELECT p_partkey // 1000 AS doc, p_partkey AS id, p_name, CAST(p_size AS BIGINT) AS s, md5('c' || p_partkey) AS ckey, md5('e' || p_partkey) AS ekey, substr(md5('e' || p_partkey), 1, 18) AS ekey9, row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) - 1 AS idx FROM part)"


def _install(rows: list[dict]) -> bytes:
    files = [(i, f"{r['p_name']}/{r['id']}.dat", r["ckey"], r["s"] * 1000, None) for i, r in enumerate(rows)]
    tags = [("Windows", "Platform", [i for i, r in enumerate(rows) if r["id"] % 2 == 0]), ("enUS", "Locale", [i for i, r in enumerate(rows) if r["s"] % 3 == 0])]
    return B.build_install(files, tags)


@query(f"WITH {_PARTS} SELECT doc, CAST(idx AS INTEGER) AS idx, p_name || '/' || id || '.dat' AS path, ckey, s * 1000 AS file_size FROM p")
def install_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07, SRC-19, VAL-01: install manifests written and read."""
    blobs = B.build_groups(_parts(spark, sf_dir), ["doc"], ["id"], _install)
    return B.rows(blobs, "install_files").select("doc", "idx", "path", _hex("ckey").alias("ckey"), "file_size")


@query(f"""WITH {_PARTS} SELECT doc, 'Windows' AS tag, 'Platform' AS tag_type, CAST(idx AS INTEGER) AS idx, s % 3 = 0 AS in_tag FROM p WHERE id % 2 = 0
UNION ALL SELECT doc, 'enUS', 'Locale', CAST(idx AS INTEGER), true FROM p WHERE s % 3 = 0""")
def install_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19, FLT-06, 29: the tags of the same manifests, and which of their files are in enUS."""
    t = B.rows(B.build_groups(_parts(spark, sf_dir), ["doc"], ["id"], _install), "install_tags").withColumn("idx", F.struct("doc", "idx"))
    asked = TB.has_file(t, "enUS", TB.in_names(t, ["Windows", "enUS", "none"]).drop("tag_pos"))
    return asked.select("doc", "tag", "tag_type", F.col("idx.idx").alias("idx"), "in_tag")


def _download(rows: list[dict]) -> bytes:
    files = [(i, r["ekey"], r["s"] << 28, r["s"] - 25, r["id"] * 3 & 0xFFFFFFFF, bytes([r["s"]])) for i, r in enumerate(rows)]
    return B.build_download(files, [("all", "Option", list(range(len(rows))))], 3, True, 1, -3)


@query(f"WITH {_PARTS} SELECT doc, CAST(idx AS INTEGER) AS idx, ekey, s << 28 AS file_size, CAST(s - 25 AS INTEGER) AS priority, id * 3 AS checksum, lpad(to_hex(s), 2, '0') AS flags FROM p")
def download_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08, SRC-20, VAL-02, 19: download manifests of version 3."""
    blobs = B.build_groups(_parts(spark, sf_dir), ["doc"], ["id"], _download)
    return B.rows(blobs, "download_files").select("doc", "idx", _hex("ekey").alias("ekey"), "file_size", "priority", "checksum", F.hex("flags").alias("flags"))


@query(f"WITH {_PARTS} SELECT doc, count(*) AS n FROM p WHERE s - 25 <= -1 GROUP BY doc")
def critical_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16, SRC-20: entries of one category of a download manifest."""
    files = B.rows(B.build_groups(_parts(spark, sf_dir), ["doc"], ["id"], _download), "download_files")
    return TB.by_category(files, "Critical", "priority").groupBy("doc").agg(F.count("*").alias("n"))


@query(f"WITH {_PARTS} SELECT doc, CAST(idx AS INTEGER) AS idx, ekey9, s * 11 AS esize FROM p")
def size_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-09, 42; SRC-21; AGG-34: size manifests, whose total is checked."""
    blobs = B.build_groups(_parts(spark, sf_dir), ["doc"], ["id"], lambda rows: B.build_size([(i, r["ekey9"], r["s"] * 11) for i, r in enumerate(rows)], [("t", "Option", [0])]))
    return B.rows(blobs, "size_entries").select("doc", "idx", _hex("ekey").alias("ekey9"), "esize")


def _encoding(rows: list[dict]) -> bytes:
    ckeys = [(r["ckey"], r["s"], [r["ekey"], r["ckey"][::-1]][: 1 + r["id"] % 2]) for r in rows]
    blob = B.build_encoding(ckeys, [(r["ekey"], r["s"] % 2, r["s"]) for r in rows], ["n", "b:{*=z}"])
    return build_container(blob, 1 << 14) if rows[0]["doc"] % 2 else blob


@query(f"WITH {_PARTS} SELECT id, ekey, s AS file_size, CASE WHEN s % 2 = 0 THEN 'n' ELSE 'b:{{*=z}}' END AS spec FROM p UNION ALL SELECT -id - 1, NULL, NULL, NULL FROM p WHERE id % 7 = 0")
def encoding_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06, 29; SRC-16..18; JN-06, 08; SCL-14; VAL-03: content key to encoding key to spec, through encoding tables, bare or in a container."""
    parts = _parts(spark, sf_dir)
    blobs = B.build_groups(parts, ["doc"], ["id"], _encoding)
    asked = parts.select("id", "ckey").union(parts.where("id % 7 = 0").select((-F.col("id") - 1).alias("id"), _key("id", "none").alias("ckey")))
    found = TB.encoding_key(asked, B.rows(blobs, "enc_ckey").drop("doc"))
    specs = B.rows(blobs, "espec").drop("doc").distinct()
    return TB.encoding_spec(found, B.rows(blobs, "enc_ekey").select("page", "pos", "ekey", "espec_index"), specs).select("id", _hex("ekey").alias("ekey"), "file_size", "spec")


def _root_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).withColumn("doc", F.floor(F.col("id") / (4 * FILE)) * 4 + F.col("id") % 4)
    p = p.withColumn("name_hash", H.path_hash(F.concat("p_name", F.lit("/"), F.col("id").cast("string"))))
    return p.withColumn("locale", F.call_function("shiftleft", F.lit(2), (F.col("s") % 3).cast("int"))).withColumn("content", F.when((F.col("s") % 5 == 0) & (F.col("doc") % 4 > 0), B.NO_NAME_HASH).otherwise(0))


def _root(rows: list[dict]) -> bytes:
    return B.build_root([(r["id"], r["ckey"], r["name_hash"], r["locale"], r["content"]) for r in rows], 1 + rows[0]["doc"] % 4)


_ROOT = "r AS (SELECT *, id // 4000 * 4 + id % 4 AS rdoc, 2 << CAST(s % 3 AS INTEGER) AS locale, CASE WHEN s % 5 = 0 AND id % 4 > 0 THEN 268435456 ELSE 0 END AS content FROM p)"


@query(f"WITH {_PARTS}, {_ROOT} SELECT rdoc AS doc, CAST(1 + rdoc % 4 AS INTEGER) AS version, id AS fdid, ckey, content = 0 AS named, CAST(locale AS BIGINT) AS locale_flags, CAST(content AS BIGINT) AS content_flags FROM r")
def root_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05, 31; SRC-14, 15; WIN-14, 15: root tables of all four versions."""
    blobs = B.build_groups(_root_rows(spark, sf_dir), ["doc"], ["id"], _root)
    return B.rows(blobs, "root").select("doc", "version", "fdid", _hex("ckey").alias("ckey"), F.col("name_hash").isNotNull().alias("named"), "locale_flags", "content_flags")


@query(f"WITH {_PARTS}, {_ROOT} SELECT id, CASE WHEN content = 0 AND s % 3 <> 2 THEN ckey END AS ckey, CASE WHEN content = 0 AND s % 3 <> 2 THEN id END AS fdid FROM r")
def root_path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03, 19; PRJ-11; SCL-01, 35: paths in any case and with either slash, to content keys, through root tables, in two of three locales."""
    rows = _root_rows(spark, sf_dir)
    root = B.rows(B.build_groups(rows, ["doc"], ["id"], _root), "root").drop("doc")
    low = F.when(F.col("id") % 2 == 0, F.upper("p_name")).otherwise(F.lower("p_name"))
    asked = rows.select("id", F.concat(low, F.when(F.col("id") % 3 == 0, F.lit("\\")).otherwise(F.lit("/")), F.col("id").cast("string")).alias("path"))
    return TB.root_by_path(asked, root, 2 | 4).select("id", _hex("ckey").alias("ckey"), "fdid")


@query(f"WITH {_PARTS}, {_ROOT}, g AS (SELECT locale, content, count(*) AS n FROM r GROUP BY locale, content) SELECT CAST(20 + sum(18 + 28 * n) AS BIGINT) AS bytes FROM g")
def root_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-33, PRJ-32: the bytes that one root table of version 4 would take."""
    r = _root_rows(spark, sf_dir).select("name_hash", F.col("locale").alias("locale_flags"), F.col("content").alias("content_flags"))
    return TB.root_size(r, 4)


@query(f"WITH {_PARTS}, {_ROOT} SELECT CAST(locale AS BIGINT) AS locale_flags, CAST(content AS BIGINT) AS content_flags, CAST(row_number() OVER (PARTITION BY locale, content ORDER BY id) - 1 AS INTEGER) AS pos, id AS fdid FROM r")
def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-15, ORD-14: the records of nested blocks, in order."""
    r = _root_rows(spark, sf_dir).groupBy(F.col("locale").cast("long").alias("locale_flags"), F.col("content").cast("long").alias("content_flags"))
    blocks = r.agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("fdid")))).alias("records")).withColumn("block", F.lit(0))
    return TB.all_records(blocks).select("locale_flags", "content_flags", "pos", "fdid")


@query(f"WITH {_PARTS} SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY ekey) - 1 AS INTEGER) AS pos, ekey, s AS size, id * 5 AS offset, CASE WHEN doc % 2 = 1 THEN CAST(id % 700 AS INTEGER) END AS archive_index FROM p")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10, 11, 30; SRC-22, 24; VAL-04, 16, 17; SCL-11..13; ORD-01: archive indexes and groups, sorted by key."""
    parts = TB.in_key_order(_parts(spark, sf_dir), "ekey", ["doc"])
    blobs = B.build_groups(parts, ["doc"], ["ekey"], lambda rows: B.build_index([(r["ekey"], r["s"], r["id"] * 5, r["id"] % 700) for r in rows], rows[0]["doc"] % 2 == 1))
    return B.rows(blobs, "cdn_index").select("doc", "pos", _hex("ekey").alias("ekey"), "size", "offset", "archive_index")


@query(f"WITH {_PARTS} SELECT doc, id % 16 AS bucket, ekey9, CAST(id % 1023 AS INTEGER) AS archive_id, id * 9 AS offset, s AS size FROM p WHERE id % 3 <> 0 UNION ALL SELECT doc, id % 16, ekey9, CAST(id % 1023 AS INTEGER), id * 9 + 1, s + 1 FROM p WHERE id % 9 = 0")
def local_index_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-18, 19; SRC-36, 37, 63; SET-06, 07; VAL-14: local indexes with their logs: a third of the entries deleted, some of them set again."""
    parts = _parts(spark, sf_dir).withColumn("bucket", F.col("id") % 16)

    def build(rows: list[dict]) -> bytes:
        base = [(r["ekey9"], r["id"] % 1023, r["id"] * 9, r["s"]) for r in rows]
        gone = [(r["ekey9"], 0, 0, 0, "Delete") for r in rows if r["id"] % 3 == 0]
        return S.build_local_index(rows[0]["bucket"], base, gone + [(r["ekey9"], r["id"] % 1023, r["id"] * 9 + 1, r["s"] + 1, "Normal") for r in rows if r["id"] % 9 == 0])

    blobs = B.build_groups(parts.withColumn("doc", F.struct("doc", "bucket")), ["doc", "bucket"], ["id"], build)
    base, log = B.rows(blobs, "local_index"), B.rows(blobs, "local_index_log")
    view = M.log_view(base.drop("pos"), log, ["doc", "bucket", "ekey9"])
    return view.select("doc.doc", F.col("bucket").cast("long").alias("bucket"), _hex("ekey9").alias("ekey9"), "archive_id", "offset", "size")


@query("SELECT s_suppkey % 16 AS bucket, max(s_suppkey) AS version, 'data/' || lower(lpad(to_hex(s_suppkey % 16), 2, '0') || lpad(to_hex(max(s_suppkey)), 8, '0')) || '.idx' AS name FROM supplier GROUP BY s_suppkey % 16")
def newest_local_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-35: of many index files, the newest of each bucket; files of other names are passed over."""
    k = F.col("s_suppkey")
    name = F.format_string("data/%02x%08x.idx", k % 16, k)
    files = table(spark, sf_dir, "supplier").select(F.explode(F.array(name, F.format_string("data/%02x%08x.old", k % 16, k + 1))).alias("name"))
    return TB.newest_indexes(files)


@query(f"WITH {_PARTS} SELECT id % 16 AS bucket, count(*) AS entries FROM p WHERE id % 3 <> 0 GROUP BY id % 16")
def live_index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-41: entries of each bucket after the log's deletions."""
    p = _parts(spark, sf_dir).select((F.col("id") % 16).alias("bucket"), "ekey9", F.col("id").alias("offset"))
    log = p.where("offset % 3 = 0").withColumn("seq", F.col("offset")).withColumn("status", F.lit("Delete"))
    return TB.live_entries(M.log_view(p, log, ["bucket", "ekey9"]))


@query(f"WITH {_PARTS} SELECT doc, id % 16 AS bucket, ekey, CASE WHEN s % 2 = 0 THEN 'Set' ELSE 'MarkResident' END AS update_type, CAST(s AS INTEGER) AS length FROM p")
def residency_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-21, SRC-44: residency tables."""
    build = lambda rows: S.build_residency([(r["id"] % 16, r["ekey"], "Set" if r["s"] % 2 == 0 else "MarkResident", (0, r["s"], 0, 0)) for r in rows])
    blobs = B.build_groups(_parts(spark, sf_dir), ["doc"], ["id"], build)
    return B.rows(blobs, "residency").select("doc", F.col("bucket").cast("long").alias("bucket"), _hex("ekey").alias("ekey"), "update_type", "span.length")


@query(f"WITH {_PARTS} SELECT doc, idx AS place, ekey9, CAST(s AS INTEGER) AS flags FROM p")
def lru_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-22, 41; SRC-45: LRU tables, the most recent first."""
    blobs = B.build_groups(_parts(spark, sf_dir), ["doc"], ["id"], lambda rows: S.build_lru([r["ekey9"] for r in rows], [r["s"] for r in rows]))
    return B.rows(blobs, "lru").select("doc", "place", _hex("ekey9").alias("ekey9"), "flags")


@query(f"WITH {_PARTS} SELECT doc, ckey AS target, s AS decoded_size, ekey AS source, s + 1 AS source_size, id AS patch_size, 0 AS patch_index FROM p UNION ALL SELECT doc, ckey, s, ckey, s + 2, id + 1, 1 FROM p WHERE id % 2 = 0")
def patch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13; SRC-26, 57; PRJ-14; VAL-20; ORD-15: patch archives."""
    build = lambda rows: S.build_patch_archive([(r["ckey"], r["s"], [(r["ekey"], r["s"] + 1, r["ekey"], r["id"], 0), (r["ckey"], r["s"] + 2, r["ekey"], r["id"] + 1, 1)][: 2 - r["id"] % 2]) for r in rows])
    e = B.rows(B.build_groups(_parts(spark, sf_dir), ["doc"], ["id"], build), "patch_edges")
    return e.select("doc", _hex("target_ckey").alias("target"), "decoded_size", _hex("source_ekey").alias("source"), "source_size", "patch_size", "patch_index")


@query(f"WITH {_PARTS} SELECT doc, idx AS pos, ekey, s AS source_size, ckey, s + 1 AS target_size, id AS encoded_size FROM p")
def patch_index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-14; SRC-27, 55, 56: patch index entries."""
    build = lambda rows: B.build_patch_entries([(r["ekey"], r["s"], r["ckey"], r["s"] + 1, r["id"], 1, r["ekey"]) for r in rows])
    e = B.rows(B.build_groups(_parts(spark, sf_dir), ["doc"], ["id"], build), "patch_index")
    return e.select("doc", "pos", _hex("source_ekey").alias("ekey"), "source_size", _hex("target_ekey").alias("ckey"), "target_size", "encoded_size")


@query(f"WITH {_PARTS}, k AS (SELECT max(id) AS m FROM p) SELECT 'patch' AS by, id FROM p, k WHERE id = m UNION ALL SELECT 'source', id FROM p, k WHERE id = m UNION ALL SELECT 'target', id FROM p, k WHERE id = m - 1 UNION ALL SELECT 'nested', id FROM p, k WHERE id = m UNION ALL SELECT 'first', id FROM p, k WHERE id = m - 1")
def patch_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-33..37, AGG-28: patches by their own key, their source and their target, flat and nested."""
    p = _parts(spark, sf_dir)
    m = p.agg(F.max("id")).first()[0]
    index = p.select("id", _key("id", "p").alias("patch_ekey"), F.col("ekey").alias("source_ekey"), F.col("ckey").alias("target_ekey"))
    nested = p.select("id", F.col("ckey").alias("target_ckey"), F.col("id").alias("pos"), F.array(F.struct(F.col("ekey").alias("source_ekey"), _key("id", "p").alias("patch_ekey"))).alias("patches"))
    own = lambda salt, k: _key(F.lit(k), salt)
    got = [
        ("patch", TB.patches(index, patch=own("p", m))),
        ("source", TB.patches(index, source=own("e", m))),
        ("target", TB.patches(index, target=own("c", m - 1))),
        ("nested", TB.patches_from(nested, own("e", m)).select(F.col("pos").alias("id"))),
        ("first", TB.first_target(nested, own("c", m - 1))),
    ]
    out = None
    for name, df in got:
        part = df.select(F.lit(name).alias("by"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_PARTS} SELECT doc, p_name || '/' || id AS path, s AS encoded_size FROM p")
def vfs_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-15, 32; SRC-28..31, 61; JN-30, 31; VAL-21: virtual file systems: path to span to container."""
    from strandline.operators.lookups import vfs_resolve

    def build(rows: list[dict]) -> bytes:
        return build_container(S.build_vfs({f"{r['p_name']}/{r['id']}": [(0, r["s"], i)] for i, r in enumerate(rows)}, [(r["ekey9"], r["s"]) for r in rows]))

    blobs = B.build_groups(_parts(spark, sf_dir), ["doc"], ["id"], build)
    offset = lambda df, c: df.withColumn(c, F.col("doc") * (1 << 40) + F.col(c))  # noqa: E731  one space for all files
    paths = offset(B.rows(blobs, "vfs_paths"), "vfs_offset")
    spans = offset(B.rows(blobs, "vfs_spans"), "offset").withColumn("spans", F.transform("spans", lambda s: s.withField("cft_offset", F.col("doc") * (1 << 40) + s["cft_offset"])))
    boxes = offset(B.rows(blobs, "vfs_containers"), "offset")
    return vfs_resolve(paths, spans.drop("doc"), boxes.drop("doc")).select("doc", "path", "encoded_size")


# --- text formats ------------------------------------------------------------------------------------------------


def _written(spark: SparkSession, lines: DataFrame, name: str, order: str | None = None) -> str:
    """The lines as text files; with ``order`` one file, for documents whose lines are few and ordered."""
    path = work_folder(spark, name)
    (lines if order is None else lines.coalesce(1).sortWithinPartitions(order)).select("line").write.text(path)
    return path


def _documents(spark: SparkSession, documents: DataFrame, name: str) -> str:
    """JSON documents in files that hold many: a file each would cost more than all the rest."""
    path = work_folder(spark, name)
    documents.select("document").write.text(path, lineSep=X.RECORD_SEPARATOR)
    return path


@query("SELECT n_nationkey AS key, n_name AS name, md5(n_name) AS hash, 7 AS seqn FROM nation")
def typed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, 02; SRC-01..04, 38: a typed table written and read."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("Key"), F.col("n_name").alias("Name"), F.unhex(F.md5("n_name")).alias("Hash"))
    path = _written(spark, X.typed_lines(n, [("Key", "DEC"), ("Name", "STRING"), ("Hash", "HEX")], ["Key"], 7), "typed", "line_no")
    return X.read_typed(spark, path).select(F.col("Key").cast("int").alias("key"), F.col("Name").alias("name"), _hex("Hash").alias("hash"), "seqn")


@query("SELECT 'key-' || n_nationkey AS key, p AS pos, CASE p WHEN 0 THEN md5(n_name) ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation, (VALUES (0), (1)) AS v(p)")
def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, 04; SRC-05, 06: key/value documents; the last of repeated keys counts."""
    n = table(spark, sf_dir, "nation").select(F.lit("d").alias("doc"), F.format_string("key-%d", "n_nationkey").alias("key"), F.posexplode(F.array(F.md5("n_name"), F.col("n_regionkey").cast("string"))).alias("pos", "value"))
    lines = X.key_value_lines(n).select("key", "line", F.lit(1).alias("at"))
    old = lines.select("key", F.concat("key", F.lit(" = old")).alias("line"), F.lit(0).alias("at"))
    return X.read_key_values(spark, _written(spark, lines.union(old), "config", "at")).select("key", "pos", "value")


@query("SELECT lower(lpad(to_hex(n_nationkey), 16, '0')) AS key_id, md5(n_name) AS key_value, 3 AS copies FROM nation")
def key_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-33, 34; SRC-09, 47, 48; VAL-07: keys as a keyring, a CSV and a text list; broken lines are passed over."""
    n = table(spark, sf_dir, "nation").select(F.lpad(F.hex(F.col("n_nationkey").cast("long")), 16, "0").alias("key_id"), F.md5("n_name").alias("key_value"), F.col("n_nationkey").alias("pos"))
    bad = spark.createDataFrame([("# a comment",), ("key-12 = zz",), ("1,2,3",), ("xyz",)], "line string")
    ring = X.read_keyring(spark, _written(spark, X.keyring_lines(n).select("line").union(bad), "ring"))
    lists = [X.read_key_list(spark, _written(spark, n.select(F.concat_ws(s, F.concat(F.lit("0x"), F.col("key_id")), "key_value").alias("line")).union(bad), "keys"), s) for s in (",", " ")]
    both = ring.select("key_id", "key_value").union(lists[0].select("key_id", "key_value")).union(lists[1].select("key_id", "key_value"))
    return both.select(F.lower("key_id").alias("key_id"), "key_value").groupBy("key_id", "key_value").agg(F.count("*").cast("int").alias("copies"))


@query("SELECT s_suppkey AS id, s_name AS product, md5(s_name) AS build_config, 'data/' || s_nationkey AS dir FROM supplier")
def build_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, 46; SNK-35; PRJ-23; FLT-41: build records and product configurations as JSON documents."""
    s = table(spark, sf_dir, "supplier")
    h = F.md5("s_name")
    rec = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("product"), F.lit("1.0").alias("version"), F.lit("7").alias("build"), *[h.alias(n) for n in ("build_config", "cdn_config", "encoding_ekey", "root_ekey", "install_ekey", "download_ekey")], F.lit("2024-01-01T00:00:00").alias("build_time"))
    arrays = s.groupBy(F.floor(F.col("s_suppkey") / FILE)).agg(F.to_json(F.collect_list(rec)).alias("document")).select("document")
    builds = X.read_builds(spark, _documents(spark, arrays, "builds"), many=True)
    config = s.select(X.product_config_json(F.struct(F.col("s_name").alias("uid"), F.concat(F.lit("data/"), F.col("s_nationkey").cast("string")).alias("dir"))).alias("document"))
    dirs = X.read_product_configs(spark, _documents(spark, config, "products"), many=True).select("product_uid", TB.game_directory(F.col("document")).alias("dir")).distinct()
    return builds.join(dirs, F.col("product") == F.col("product_uid")).select("id", "product", "build_config", "dir")


@query("""SELECT s_name AS product, r AS region, CASE WHEN s_suppkey % 2 = 0 THEN 'own/' || s_suppkey ELSE 'base' END AS path FROM supplier, (VALUES ('us'), ('eu'), ('cn'), ('kr'), ('tw')) AS v(r)""")
def delivery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-24, PRJ-25: delivery rows of each build; a build's own path wins."""
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("product"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("own/"), F.col("s_suppkey").cast("string"))).alias("cdn_path"))
    return X.cdns_table(b, "base", ["h1", "h2"], "config").select("product", F.col("Name").alias("region"), F.col("Path").alias("path"))


@query("SELECT 'p' || s_nationkey AS product, 5::BIGINT AS seqn, count(*) AS builds FROM supplier GROUP BY s_nationkey")
def response_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-25, 26; AGG-38: each product once, and its builds."""
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("product"))
    per = b.groupBy(F.col("product").alias("p")).agg(TB.total_builds().alias("builds"))
    return X.summary_table(b, 5).join(per, F.col("Product") == F.col("p")).select(F.col("Product").alias("product"), F.col("Seqn").alias("seqn"), "builds")


@query("SELECT n_name AS name, 'https://' || lower(n_name) || '.version.example.net' AS https_url, 'http://' || lower(n_name) || '.patch.example.net:1119' AS http_url, lower(n_name) || '.version.example.net:1119' AS address FROM nation")
def service_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-22: the services of each region."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), *TB.region_urls(F.lower("n_name"), F.lit("example.net")))


@query("SELECT p_partkey AS id, 'b:{22=n,' || CASE WHEN p_size % 4 > 0 THEN (p_size % 4 * 10) || '=z,' ELSE '' END || (p_size * 32) || '=n,' || (p_size * 4096) || '=n,' || CASE WHEN p_size % 3 > 0 THEN (p_size % 3 * 32) || '=n,' || (p_size % 3 * 4096) || '=n,' ELSE '' END || '*=z}' AS layout, CAST(10 + CASE WHEN p_size % 2 = 0 THEN 41 + octet_length(encode(p_name)) ELSE 0 END + p_size * 36 AS BIGINT) AS header FROM part")
def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-28, 31: layout of an encoding table as a spec, and header size of a patch archive."""
    s = F.col("p_size")
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), TB.encoding_layout(s % 4 * 10, s, s % 3).alias("layout"), TB.patch_header_size(s, F.when(s % 2 == 0, F.col("p_name"))).cast("long").alias("header"))


# --- figures and caches -------------------------------------------------------------------------------------------


@query("""SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id""")
def active_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-38: the first row marked active of each document."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("pos"), F.when(F.col("event_type") == "click", "1").otherwise("0").alias("Active"))
    return TB.active_row(e, ["user_id"]).select("user_id", "event_id")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN event_id % 3 = 0 WHEN 'view' THEN true ELSE false END AS again FROM events")
def retryable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-48."""
    kind = F.when(F.col("event_type") == "click", "http").when(F.col("event_type") == "view", "timeout").otherwise("io")
    return table(spark, sf_dir, "events").select("event_id", TB.is_retryable(kind, F.when(F.col("event_id") % 3 == 0, 503).otherwise(404), [429, 503]).alias("again"))


@query("""SELECT count(*) FILTER (event_type = 'click') AS retry_total, count(*) FILTER (event_type = 'click' AND event_id % 2 = 0) AS retry_successful, count(*) FILTER (event_type = 'click' AND event_id % 2 = 1) AS retry_failed,
  CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN count(*) FILTER (event_type = 'click' AND event_id % 2 = 0) / count(*) FILTER (event_type = 'click') ELSE 1.0 END AS retry_success_rate,
  count(*) FILTER (event_type = 'view') AS failover_count, count(*) FILTER (event_id % 2 = 1) AS error_count, count(*) AS total_requests, count(*) FILTER (event_id % 2 = 1) / count(*) AS error_rate, avg(CAST(event_id AS DOUBLE)) AS avg_ms FROM events""")
def recovery_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-71."""
    e = table(spark, sf_dir, "events").select((F.col("event_type") == "click").alias("retry"), (F.col("event_id") % 2 == 0).alias("ok"), (F.col("event_type") == "view").alias("failover"), F.col("event_id").cast("double").alias("ms"))
    return TB.recovery_stats(e)


@query("SELECT count(*) FILTER (waste > 0.3) AS archives_compacted, CAST(sum(size - used) FILTER (waste > 0.3) AS BIGINT) AS bytes_reclaimed, CAST(sum(n) FILTER (waste > 0.3) AS BIGINT) AS entries_moved FROM (SELECT sum(CAST(p_size AS BIGINT)) AS size, sum(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END) AS used, count(*) AS n, (sum(p_size) - sum(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END)) / sum(p_size) AS waste FROM part GROUP BY p_brand)")
def compaction_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-68."""
    a = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(F.col("p_size").cast("long")).alias("size"), F.sum(F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.col("p_size"))).alias("used"), F.count("*").alias("entries"))
    return TB.compaction_totals(a)


@query("SELECT count(*) AS n, CAST(sum(event_id) // count(*) AS BIGINT) AS mean_ns FROM events")
def validation_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-69."""
    return TB.mean_validation_time(table(spark, sf_dir, "events").select(F.col("event_id").alias("ns")))


@query("SELECT (SELECT count(*) FROM supplier) AS total_servers, (SELECT count(*) FROM supplier WHERE s_nationkey % 2 = 0) AS https_servers, (SELECT count(*) FROM supplier WHERE s_nationkey % 2 = 1) AS http_servers, (SELECT count(*) FROM nation) AS total_paths")
def bootstrap_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-61."""
    return TB.bootstrap_stats(table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 2 == 0).alias("https")), table(spark, sf_dir, "nation"))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT count(*) AS total_entries, count(*) FILTER (floor(epoch(now)) - floor(epoch(ts)) <= 86400) AS valid_entries, count(*) FILTER (floor(epoch(now)) - floor(epoch(ts)) > 86400) AS expired_entries FROM events, m")
def path_cache_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-66."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    return TB.path_cache_stats(e.select(F.col("ts").alias("cached_at")), F.lit(now), 86_400)


@query("WITH m AS (SELECT max(ts) AS now FROM events), last AS (SELECT user_id, max(event_id) FILTER (floor(epoch(ts)) + 43200 > epoch(now)) AS event_id FROM events, m GROUP BY user_id) SELECT user_id, event_id FROM last")
def cache_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-28, SRC-54, STR-10, FLT-39: rows stored with a time to live, and the newest valid one of each key."""
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts").alias("now")).first()["now"])
    cache = TB.store_with_ttl(e.select("user_id", "event_id", "ts"), F.col("ts"), 43_200).withColumn("stored_at", F.col("event_id"))
    return TB.cache_get(e.select("user_id").distinct(), cache, "user_id", now).select("user_id", "event_id")


@query("SELECT p.p_partkey AS archive, CASE WHEN p.p_size % 2 = 0 THEN md5('d' || p.p_partkey) END AS data, p.p_size % 2 = 0 AND p.p_size % 4 = 0 AS same FROM part p")
def range_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-46, 48: ranges from a cache by archive, offset and length, and whether their bytes are those expected."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("archive"), (F.col("p_partkey") * 7).alias("offset"), F.col("p_size").alias("length"), F.md5(F.concat(F.lit("d"), F.col("p_partkey").cast("string"))).alias("bytes"))
    odd = F.col("length") % 2 != 0
    cache = p.select("archive", F.when(odd, F.col("offset") + 1).otherwise(F.col("offset")).alias("offset"), "length", F.col("bytes").alias("data"))
    asked = p.select("archive", "offset", "length", F.when(F.col("length") % 4 == 0, F.col("bytes")).otherwise("other").alias("want"))
    return TB.same_content(TB.cached_ranges(asked, cache), "data", "want").select("archive", "data", "same")


@query("SELECT count(*) AS loaded_entries, least(count(*), CAST(ceil((count(*) * 100 - 5000) / 100.0) AS BIGINT)) AS entries_evicted, least(count(*), CAST(ceil((count(*) * 100 - 5000) / 100.0) AS BIGINT)) * 100 AS bytes_freed, count(*) - least(count(*), CAST(ceil((count(*) * 100 - 5000) / 100.0) AS BIGINT)) AS active_entries FROM part")
def lru_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07, ORD-12: an LRU table brought under its size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("last_access"))
    return TB.lru_cycle(p, 5000, 100, ["last_access", "key"])


@query("SELECT count(*) AS files, CAST(sum(1 + p_size % 2) AS BIGINT) AS patches FROM part")
def patch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-28."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("patches"))
    return TB.patch_entry_count(p)


@query()
def priority_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16: the text report; a test compares its figures."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 12 - 2).alias("eff"), (F.col("p_size").cast("long") * 1000).alias("size"))
    return TB.report(p)

