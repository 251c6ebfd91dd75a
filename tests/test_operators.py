"""Operators on small tables with the corner cases that the oracles' tables lack."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import aggregates as A
from strandline.operators import folds as W
from strandline.operators import lookups as J
from strandline.operators import merges as M
from strandline.streaming import state as ST


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_tags_empty_and_unknown(spark):
    files = spark.createDataFrame([(0,), (1,)], "idx int")
    bridge = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "idx int, tag string")
    assert rows(J.in_all_tags(files, bridge, ["a", "b"])) == [(0,)]
    assert rows(J.in_all_tags(files, bridge, ["a", "zz"])) == []
    assert rows(J.in_all_tags(files, bridge, [])) == []
    assert len(rows(J.in_all_tags(files, bridge, [], empty_means_all=True))) == 2
    assert rows(J.in_any_tag(files, bridge, ["b", "zz"])) == [(0,)]
    assert rows(J.in_any_tag(files, bridge, [])) == []


def test_first_match_ties(spark):
    t = spark.createDataFrame([(1, 0, 1, "x"), (1, 0, 0, "y"), (2, 5, 0, "z")], "k int, block int, pos int, v string")
    assert rows(J.first_match(spark.createDataFrame([(1,), (3,)], "k int"), t, ["k"], ["block", "pos"]).select("k", "v")) == [(1, "y")]


def test_resolve_all_fails(spark):
    t = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match"):
        J.resolve_all(spark.createDataFrame([(1,), (2,)], "k int"), t, ["k"]).collect()


def test_overlap_half_open(spark):
    r = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 10, 20), ("a", 3, 5, 5), ("b", 4, 0, 100)], "k string, id int, start long, end long")
    q = spark.createDataFrame([("a", 9, 9, 11)], "k string, id int, start long, end long")
    for width in (1, 3, 1000):
        assert rows(J.overlap_join(r, q, ["k"], width).select("r_id"), "r_id") == [(1,), (2,)]


def test_log_view(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    log = spark.createDataFrame([(1, "c", 0, "Normal"), (1, None, 1, "Delete"), (3, "d", 2, "Normal")], "k int, v string, seq long, status string")
    assert rows(M.log_view(base, log, ["k"]), "k") == [(2, "b"), (3, "d")]
    more = M.append_log(log, spark.createDataFrame([(1, "e", 0)], "k int, v string, pos int"), "Normal")
    assert (1, "e") in rows(M.log_view(base, more, ["k"]))


def test_coalescing(spark):
    r = spark.createDataFrame([("a", 0, 9), ("a", 2, 4), ("a", 10, 12), ("a", 20, 25), ("b", 0, 0)], "k string, start long, end long")
    assert rows(W.coalesce_ranges(r, ["k"], 0), "k", "start") == [("a", 0, 12), ("a", 20, 25), ("b", 0, 0)]
    assert rows(W.coalesce_ranges(r, ["k"], 7), "k", "start") == [("a", 0, 25), ("b", 0, 0)]
    assert rows(W.coalesce_capped(r, ["k"], 7, 15), "k", "start") == [("a", 0, 12), ("a", 20, 25), ("b", 0, 0)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "size long, eff int, ok boolean, idx int, file_size long, tag string")
    assert A.essential_summary(none).first()["essential_percent"] == 0.0
    assert A.success_rate(none, "ok").first()[0] == 1.0
    assert tuple(A.install_stats(none, none).first()) == (0, 0, 0, 0)
    assert A.size_stats(none).first()["mean_bytes"] == 0.0


def test_p95_rank(spark):
    for n in (1, 10, 19, 20, 100, 101):
        df = spark.createDataFrame([("a", i) for i in range(n)], "k string, v int")
        assert A.p95(df, ["k"], "v").first()["p95"] == min(n - 1, int(n * 0.95 + 0.5))


def test_merge_plan(spark):
    s = spark.createDataFrame([(0, 1, 10, 100), (0, 2, 30, 100), (0, 3, 90, 100), (0, 4, 0, 100)], "group long, segment long, used long, size long")
    assert rows(M.merge_plan(s, 0.5, 100)) == [(0, 1, 2, 30)]


def _moves_by_trying_all(rows, capacity):
    """The rule as it reads: rows are (segment, used)."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    fill, gone, out = dict(rows), set(), []
    for s, u in rows:
        room = [t for t in fill if t not in gone and t != s and fill[t] + u <= capacity]
        if room and s not in {t for _, t, _ in out}:
            to = max(room, key=lambda t: (fill[t], -t))
            out.append((s, to, fill[to]))
            fill[to] += u
            gone.add(s)
    return out


def test_merge_plan_of_large_groups(spark):
    import random
    import time

    r = random.Random(3)
    for n in [0, 1, 2, 3] + [r.randrange(40) for _ in range(300)]:
        top = r.choice([3, 30, 500])
        rows_ = [(r.randrange(n) if top == 30 else i, r.randrange(1, top + 1)) for i in range(n)]
        capacity = r.choice([top // 2, top, 2 * top, 5 * top])
        rows_ = sorted(rows_, key=lambda x: (x[1], x[0]))
        assert M._moves([s for s, _ in rows_], [u for _, u in rows_], capacity) == _moves_by_trying_all(rows_, capacity)
    big = spark.range(100_000).selectExpr("id % 2 as `group`", "id as segment", "id * 7 % 500 as used", "1000L as size")
    began = time.time()
    assert M.merge_plan(big, 0.5, 1000).count() > 50_000
    assert time.time() - began < 30


def test_allocate(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([60, 50, 40, 10])], "k string, i long, size long")
    assert rows(W.allocate(df, ["k"], ["i"], "size", 100).select("i", "segment", "segment_offset"), "i") == [(0, 0, 0), (1, 1, 0), (2, 0, 60), (3, 1, 50)]


def test_lru_stream_equals_batch(spark, tmp_path):
    data = spark.createDataFrame([(c, i, str((i * 7 + c) % 6)) for c in range(3) for i in range(40)], "cache_id long, seq long, key string")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ST.lru_stream(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), 3)
    q = stream.writeStream.format("memory").queryName("lru").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = spark.sql("select * from lru")
    assert rows(got, "cache_id", "seq") == rows(ST.lru_batch(data, 3), "cache_id", "seq")


def test_lru_batch_holds_a_chunk_only(spark, monkeypatch):
    import random

    r = random.Random(6)
    log = [(r.randrange(2), i * i, str(r.randrange(12))) for i in range(900)] + [(7, i, "only") for i in range(5)]
    want = []
    for c in (0, 1, 7):
        want += [(c, *o) for o in ST.lru_fold([], [(s, k) for x, s, k in log if x == c], 8)[1]]
    fold, most = ST.lru_fold, spark.sparkContext.accumulator(0)

    def counted(keys, touches, capacity):
        most.add(1)
        assert len(touches) <= 120
        return fold(keys, touches, capacity)

    monkeypatch.setattr(ST, "lru_fold", counted)
    data = spark.createDataFrame(log, "cache_id long, seq long, key string")
    for n in (50, 100):
        assert rows(ST.lru_batch(data, 8, n), "cache_id", "seq") == sorted(want)


def test_event_windows_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = ST.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from win").first()[0] == events.count()


def test_reassemble_checks_external_key(spark):
    c = spark.createDataFrame([("d", 1, b"lo"), ("d", 0, b"hel")], "doc string, idx int, data binary").withColumn("key", F.unhex(F.md5(F.lit("hello"))))
    got = ST.reassemble(c).first()
    assert (bytes(got["content"]), got["chunks"], got["valid"]) == (b"hello", 2, True)


def test_weighted_pick(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "host string, score double")
    assert W.weighted_pick(s, "score", 0.1, "host").first()["host"] == "a"
    assert W.weighted_pick(s, "score", 0.5, "host").first()["host"] == "b"


def test_extension_points(spark):
    from strandline.operators import extension as X
    from strandline.sources import binary as B

    X.register_hook("short", lambda data, key: F.octet_length(data) < 3)
    df = spark.createDataFrame([(b"ab", None), (b"", None), (b"abcd", None)], "content binary, key binary")
    got = X.validate_with(df, ["not_empty", "short", "md5"]).select("failed").collect()
    assert [r["failed"] for r in got] == [["md5"], ["not_empty", "md5"], ["short", "md5"]]
    rows = [(bytes([i]) * 16, i, i, None) for i in range(1, 6)]
    assert X.round_trip(B.build_index(rows), lambda b: [r[1:] for r in B.parse_index(b)], B.build_index)
    assert X.varint(b"\xac\x02\x01") == (300, 2)
    keys = spark.createDataFrame([("00000000000000AB", "00" * 16), ("cd", "11" * 16)], "key_id string, key_value string")
    chunks = spark.createDataFrame([("00000000000000ab",)], "key_id string")
    assert X.with_keys(chunks, keys) == {0xAB: bytes(16)}
    blobs = spark.createDataFrame([("d", b"0123456789")], "doc string, content binary")
    index = spark.createDataFrame([("d", 2, 3), ("d", 8, 5)], "doc string, offset int, size int")
    got = X.read_resident(index, blobs).orderBy("offset").collect()
    assert [(bytes(r["data"]), r["resident"]) for r in got] == [(b"234", True), (b"89", False)]
    assert X.row_map(["offset"]) is not None


def test_renumber_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "RUN", 4)
    files = spark.range(40).select(F.col("id").cast("int").alias("idx"), F.col("id").cast("string").alias("path"))
    bridge = spark.createDataFrame([(i, "a") for i in range(0, 40, 3)], "idx int, tag string")
    gone = files.where("idx % 7 = 3 or idx between 20 and 27").select("idx")
    got_files, got_bridge = M.remove_and_renumber(files, bridge, gone)
    left = [i for i in range(40) if not (i % 7 == 3 or 20 <= i <= 27)]
    assert rows(got_files, "idx") == [(k, str(i)) for k, i in enumerate(left)]
    assert [r[0] for r in rows(got_bridge, "idx")] == [left.index(i) for i in range(0, 40, 3) if i in left]


def test_p95_of_large_groups(spark, monkeypatch):
    """The narrowed search gives the sorted value at the rank, for repeated and for distinct values."""
    import random

    from strandline.operators import aggregates as A

    monkeypatch.setattr(A, "NARROW", 200)
    r = random.Random(2)
    groups = {"a": [r.random() for _ in range(3000)], "b": [r.randint(0, 3) * 1.0 for _ in range(2500)], "c": [1.0] * 400, "d": [r.random() for _ in range(30)], "e": [float(i) for i in range(201)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double")
    got = {x["k"]: (x["p95"], x["n"]) for x in A.p95(df, ["k"], "v").collect()}
    assert got == {k: (sorted(v)[min(len(v) - 1, int(len(v) * 0.95 + 0.5))], len(v)) for k, v in groups.items()}
    assert A.p95(df, [], "v").first()["n"] == sum(map(len, groups.values()))


def test_places_over_runs(spark):
    from strandline.operators.topk import with_place

    rows = [(i, (i * 7) % 5 - 2) for i in range(1000)]
    got = {r["idx"]: r["place"] for r in with_place(spark.createDataFrame(rows, "idx long, eff int"), run=64).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}


def test_small_looks_at_bytes(spark):
    from strandline.operators.lookups import small

    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(small(wide))
    assert not hinted(small(wide, size=5000))
    assert not hinted(small(wide, rows=9))


def test_report(spark):
    from strandline.operators import tables as TB

    df = spark.createDataFrame([(-1, 1024), (0, 2048), (4, 1536)], "eff int, size long")
    text = TB.report(df, 2).first()["report"]
    assert text.startswith("Total Files: 3\nTotal Size: 4.5 KB\nPriority Range: -1 to 4\nBase Priority Adjustment: 2\nEssential Content: 66.7%\n")
    assert [x.split(":")[0].strip() for x in text.split("Breakdown:\n")[1].split("\n")] == ["Critical", "Essential", "Normal"]


def test_spread_gives_tasks_by_rows(spark):
    from strandline.plans.session import spread

    df = spark.range(1000).selectExpr("id", "id % 7 as b")
    assert [spread(df, by, n).rdd.getNumPartitions() for by, n in (("id", 100), (("id", "b"), 300), ("id", 5000))] == [10, 4, 1]
    assert rows(spread(df, ("id", "b"), 10), "id") == rows(df, "id") and spread(df.where("id < 0"), "id", 10).count() == 0
