"""Round trips of every format, and text documents with their corner cases."""

import os

import pytest
from pyspark.sql import functions as F

from strandline.functions.chunks import FormatError
from strandline.sources import binary as B
from strandline.sources import text as X


def key(n=16):
    return os.urandom(n)


def put(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def test_manifests():
    tags = [("Windows", "Platform", [0, 3, 18]), ("enUS", "Locale", list(range(19))), ("none", "Option", [])]
    files = [(i, f"a/{i}.txt", key(), i * 7, None) for i in range(19)]
    got = B.parse_install(B.build_install(files, tags))
    assert got["files"] == files
    assert got["tags"] == tags
    typed = [(*f[:4], 1) for f in files]
    assert B.parse_install(B.build_install(typed, tags, 2))["files"] == typed
    down = [(i, key(), i * 10**9, i - 5, i, b"ab") for i in range(11)]
    got = B.parse_download(B.build_download(down, tags[:0], 3, True, 2, -3))
    assert got["files"] == down
    assert got["base_priority"] == -3
    with pytest.raises(FormatError):
        B.build_download(down, [], 1)
    sizes = [(i, key(9), i) for i in range(5)]
    for v in (1, 2):
        assert B.parse_size(B.build_size(sizes, [], v))["files"] == sizes
    bad = bytearray(B.build_size(sizes, []))
    bad[-1] ^= 1
    with pytest.raises(FormatError):
        B.parse_size(bytes(bad))


def test_encoding():
    c = [(key(), i, [key() for _ in range(1 + i % 3)]) for i in range(500)]
    e = [(key(), i % 3, i) for i in range(500)]
    raw = B.build_encoding(c, e, ["n", "z"], "b:{*=n}")
    got = B.parse_encoding(raw)
    assert [(x[2], x[3], x[4]) for x in got["ckeys"]] == sorted(c)
    assert [(x[2], x[3], x[4]) for x in got["ekeys"]] == sorted(e)
    assert got["trailing"] == "b:{*=n}"
    bad = bytearray(raw)
    bad[raw.rindex(sorted(c)[0][0]) + 8] ^= 1  # in the page, not in the index of first keys
    with pytest.raises(FormatError):
        B.parse_encoding(bytes(bad))


@pytest.mark.parametrize("version", [1, 2, 3, 4])
def test_root(version):
    rows = [(i * 3 + i % 2, key(), i - 9, 2 if i % 2 else 6, 0) for i in range(300)]
    if version > 1:
        rows += [(i, key(), None, 4, B.NO_NAME_HASH) for i in range(20)]
    got = B.parse_root(B.build_root(rows, version))
    assert {r[0] for r in got} == {version}
    assert sorted((x[3], x[4], x[5], x[6], x[7]) for x in got) == sorted(rows)
    assert B.parse_root(B.build_root(rows, version)[:-5])  # a broken last block ends the scan


def test_indexes():
    rows = [(key(), i, i * 5, None) for i in range(1000)]
    raw = B.build_index(rows)
    assert [x[1:] for x in B.parse_index(raw)] == sorted(rows)
    grouped = [(key(), i, i * 5, i % 7) for i in range(1000)]
    assert [x[1:] for x in B.parse_index(B.build_index(grouped, True))] == sorted(grouped)
    assert B.parse_index(B.build_index([])) == []
    with pytest.raises(FormatError):
        B.parse_index(raw[:-1] + bytes([raw[-1] ^ 1]))
    log = [(key(9), i % 1023, i, i, "Delete" if i % 5 == 0 else "Normal") for i in range(50)]
    assert [x[1:] for x in B.parse_log(B.build_log(log))] == log
    bad = bytearray(B.build_log(log))
    bad[10] ^= 1
    with pytest.raises(FormatError):
        B.parse_log(bytes(bad))
    base = sorted((key(9), i % 1023, i, i) for i in range(50))
    assert [x[1:] for x in B.parse_local_records(B.build_local_records(base))] == base
    patch = [(key(), 1, key(), 2, 3, 4, key()) for _ in range(5)]
    assert [x[1:] for x in B.parse_patch_entries(B.build_patch_entries(patch))] == patch


def test_read_binary(spark, tmp_path):
    for n in range(3):
        put(tmp_path / "d", f"{n}.index", B.build_index([(key(), i, i * 5, None) for i in range(200)]))
    got = B.read(spark, "cdn_index", str(tmp_path / "d"), "*.index")
    assert got.count() == 600
    assert got.select("doc").distinct().count() == 3
    built = B.build_groups(got, ["doc"], ["pos"], lambda rows: B.build_index([(r["ekey"], r["size"], r["offset"], None) for r in rows]))
    originals = {(tmp_path / "d" / f"{n}.index").read_bytes() for n in range(3)}
    assert {bytes(r["content"]) for r in built.collect()} == originals


TABLE = "# note\nName!STRING:0|Key!HEX:16|Count!DEC:4\n## seqn = 12\n\na|00ff|5\nb||\n"


def test_typed_table(spark, tmp_path):
    path = put(tmp_path / "t", "x.txt", TABLE)
    got = [tuple(r) for r in X.read_typed(spark, path).orderBy("pos").collect()]
    assert [(g[0], None if g[1] is None else bytes(g[1]), g[2], g[3]) for g in got] == [("a", b"\x00\xff", 5, 12), ("b", None, None, 12)]
    bad = put(tmp_path / "bad", "x.txt", TABLE + "c|1\n")
    with pytest.raises(Exception, match="wrong number of fields"):
        X.read_typed(spark, bad).collect()
    spark.dataSource.register(X.TypedSource)
    direct = spark.read.format("typedtable").load(f"{path}/x.txt")
    assert [r["Count"] for r in direct.collect()] == [5, None]
    fields = X.parse_header("Name!STRING:0|Key!HEX:16|Count!DEC:4")
    lines = [r["line"] for r in X.typed_lines(direct, fields, ["Name"], 12).orderBy("line_no").collect()]
    assert lines == ["Name!STRING:0|Key!HEX:16|Count!DEC:4", "## seqn = 12", "a|00ff|5", "b||"]
    with pytest.raises(X.FormatError):
        X.parse_header("Name!FLOAT:0")


def test_key_values(spark, tmp_path):
    text = "# c\nroot = aa\nroot = bb\narchives = x y z\narchives-index-size = 1 bad 3\ninstall = k1\ninstall-size = 5 6\nvfs-1 = p\nvfs-2 = q\nvfs-4 = r\nbuild-partial-priority = a:1,b,c:x,d:4\n"
    kv = X.read_key_values(spark, put(tmp_path / "k", "c", text)).cache()
    assert [r["value"] for r in kv.where("key = 'root'").collect()] == ["bb"]
    assert [(r["name"], r["size"]) for r in X.archives(kv).orderBy("i").collect()] == [("x", 1), ("y", 3), ("z", None)]
    assert tuple(X.key_pairs(kv, "install").drop("doc").first()) == ("k1", None, 5, 6)
    assert [r["value"] for r in X.numbered_entries(kv).orderBy("n").collect()] == ["p", "q"]
    assert [(r["entry"], r["priority"]) for r in X.partial_priorities(kv).orderBy("entry").collect()] == [("a", 1), ("d", 4)]
    assert "archives = x y z" in {r["line"] for r in X.key_value_lines(kv).collect()}
    assert X.required_keys(kv, ["root", "encoding"]).first()["missing"] == ["encoding"]


def test_key_lists(spark, tmp_path):
    text = "# k\n0x1F,00112233445566778899aabbccddeeff\nzz,00\n20,00112233445566778899AABBCCDDEEFF\n1,2,3\n"
    got = X.read_key_list(spark, put(tmp_path / "l", "k.csv", text)).orderBy("pos").collect()
    assert [r["key_id"] for r in got] == ["000000000000001f", "0000000000000020"]
    ring = X.read_keyring(spark, put(tmp_path / "r", "k", "key-0123456789ABCDEF = 00112233445566778899aabbccddeeff\nother = 1\n")).collect()
    assert [r["key_id"] for r in ring] == ["0123456789abcdef"]


def test_builds_and_responses(spark, tmp_path):
    h = "0" * 32
    b = {"id": 1, "product": "p", "version": "1.0", "build": "7", "build_config": h, "cdn_config": h, "build_time": "2024-01-01T00:00:00", "encoding_ekey": h, "root_ekey": h, "install_ekey": h, "download_ekey": h}
    import json

    got = X.read_builds(spark, put(tmp_path / "b", "b.json", json.dumps([b, {**b, "id": 2, "product": "q", "cdn_path": "own"}]))).cache()
    assert got.count() == 2
    assert X.versions_table(got).count() == 14
    cdns = X.cdns_table(got, "base", ["h1", "h2"], "cfg")
    assert {r["Path"] for r in cdns.collect()} == {"base", "own"}
    assert [r["priority"] for r in X.server_table(cdns.where("product = 'p'"), "us").orderBy("priority").collect()] == [10, 20]
    assert [r["Product"] for r in X.summary_table(got, 3).collect()] == ["p", "q"]
    with pytest.raises(Exception, match="bad build record"):
        X.read_builds(spark, put(tmp_path / "bad", "b.json", json.dumps([{**b, "build_config": "x"}]))).collect()
    m = spark.range(1).select(X.mime_wrap(F.lit("a|b\nc|d")).alias("m"))
    p = m.select(X.mime_parts(F.col("m")).alias("p"), X.mime_parts(F.concat(F.lit(" "), F.col("m"))).alias("q")).first()
    assert (p["p"]["body"], p["p"]["valid"], p["q"]["valid"]) == ("a|b\nc|d", True, False)


def test_storage_formats(spark, tmp_path):
    from strandline.operators.lookups import vfs_resolve
    from strandline.sources import storage as S

    rows = sorted((key(9), i % 1023, i, i) for i in range(300))
    log = [(key(9), 1, 2, 3, "Normal"), (key(9), 0, 0, 0, "Delete")]
    raw = S.build_local_index(5, rows, log)
    bucket, got, got_log = S.parse_local_index(raw)
    assert (bucket, [r[1:] for r in got], [r[1:] for r in got_log]) == (5, rows, log)
    with pytest.raises(FormatError):
        S.parse_local_index(raw[:50] + bytes([raw[50] ^ 1]) + raw[51:])
    res = [(b, key(), u, (0, 5, 0, 0)) for b in (0, 3) for u in ("Set", "Delete") for _ in range(20)]
    assert [(r[0], *r[2:]) for r in S.parse_residency(S.build_residency(res))] == res
    keys = [key(9) for _ in range(5)]
    assert [r[1] for r in S.parse_lru(S.build_lru(keys))] == keys
    assert S.parse_lru(S.build_lru([])) == []
    assert S.parse_lru(S.build_lru(keys)[:-1]) is None
    head = S.build_local_header(key(), 100, 7)
    assert S.parse_local_header(head, 7)["valid"]
    assert not S.parse_local_header(head, 8)["valid"]
    edges = [(key(), i, [(key(), 1, key(), 2, 0) for _ in range(1 + i % 2)]) for i in range(150)]
    flat = [(t, s, *p) for t, s, ps in sorted(edges) for p in ps]
    assert S.parse_patch_archive(S.build_patch_archive(edges)) == flat
    assert S.parse_patch_archive(S.build_patch_archive(edges, info=(key(), key(), 1, 2, "z"))) == flat
    files = {"a/b/c.txt": [(0, 10, 1)], "a/d": [(0, 4, 0), (4, 4, 2)], "top": []}
    boxes = [(key(9), i) for i in range(40)]
    vfs = S.build_vfs(files, boxes)
    parsed = S.parse_vfs(vfs)
    assert {p for p, _ in parsed["paths"]} == set(files)
    assert [c[1:3] for c in parsed["containers"]] == boxes
    path = put(tmp_path / "v", "x.vfs", vfs)
    got = vfs_resolve(*(B.read(spark, k, path) for k in ("vfs_paths", "vfs_spans", "vfs_containers"))).collect()
    assert {r["path"]: r["encoded_size"] for r in got} == {"a/b/c.txt": 1, "a/d": 0, "top": None}


def test_paged_index(spark, tmp_path):
    rows = sorted((key(), i, i * 3, i % 9) for i in range(3000))
    for group in (False, True):
        path = tmp_path / f"x{group}.index"
        path.write_bytes(B.build_index(rows, group))
        spark.dataSource.register(B.PagedIndex)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        df = spark.read.format("pagedindex").load(str(path))
        want = B.parse_index(path.read_bytes())
        assert [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.orderBy("pos").collect()] == want
        one = df.where(F.col("ekey") == F.lit(bytearray(rows[1234][0])))
        assert [r["size"] for r in one.collect()] == [rows[1234][1]]
        assert one.rdd.getNumPartitions() == 1
        assert df.where(F.col("ekey") == F.lit(bytearray(b"\xff" * 16))).count() == 0
    empty = tmp_path / "empty.index"
    empty.write_bytes(B.build_index([]))
    assert spark.read.format("pagedindex").load(str(empty)).count() == 0


def test_read_ranges(spark, tmp_path):
    (tmp_path / "a").write_bytes(bytes(range(256)) * 8)
    (tmp_path / "b").write_bytes(b"short")
    asked = [(f"file://{tmp_path}/a", 256, 4), (f"file://{tmp_path}/a", 0, 2), (f"{tmp_path}/b", 3, 10), (f"{tmp_path}/b", 9, 1)]
    got = {(r["path"], r["offset"]): bytes(r["data"]) for r in B.read_ranges(spark.createDataFrame(asked, "path string, offset long, size long")).collect()}
    assert list(map(got.get, [(p, o) for p, o, _ in asked])) == [b"\0\1\2\3", b"\0\1", b"rt", b""]


def test_log_ends_at_an_empty_page():
    rows = [(key(9), 1, 2, 3, "Normal")]
    raw = B.build_log(rows)
    assert [r[1:] for r in B.parse_log(raw + bytes(512) + raw)] == rows
    with pytest.raises(FormatError):
        B.parse_log(raw[:8] + bytes([raw[8] ^ 1]) + raw[9:])


def test_product_configs(spark, tmp_path):
    good = put(tmp_path / "p", "a.json", '{"all":\n {"config": {"product": "x", "form": {"game_dir": {"dirname": "D"}}}}}')
    from strandline.operators import tables as TB

    row = X.read_product_configs(spark, good).select("product_uid", TB.game_directory(F.col("document")).alias("d"), TB.game_directory(F.lit("{}")).alias("none")).first()
    assert tuple(row) == ("x", "D", None)
    with pytest.raises(Exception, match="bad product configuration"):
        X.read_product_configs(spark, put(tmp_path / "q", "a.json", "no json")).collect()


def test_many_documents_in_a_file(spark, sf_dir, tmp_path, monkeypatch):
    from strandline.plans import catalog_formats

    docs = spark.range(500).select(X.product_config_json(F.struct(F.format_string("p\n\x1e\u00e9%d", "id").alias("uid"), F.lit("d").alias("dir"))).alias("document"))
    docs.coalesce(1).write.text(str(tmp_path / "p"), lineSep=X.RECORD_SEPARATOR)
    got = X.read_product_configs(spark, str(tmp_path / "p"), many=True).select("product_uid").collect()
    assert {r[0] for r in got} == {f"p\n\x1e\u00e9{i}" for i in range(500)} and len(got) == 500
    with pytest.raises(Exception, match="a bad product configuration"):
        X.read_product_configs(spark, put(tmp_path / "q", "a.json", "{}\x1eno json"), many=True).collect()
    monkeypatch.setattr(catalog_formats, "work_folder", lambda spark, name: f"{tmp_path}/work/{name}")
    assert catalog_formats.build_records(spark, sf_dir).count() > 0
    one = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    files = [f for f in (tmp_path / "work").rglob("*.txt")]
    assert files and len(files) < one  # not a file for each supplier
