"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import contamination, embedding_dedup, hashing, html_extract, minhash_dedup, packing, quality, suffix_dedup, token_counts, toxicity, url_filter, work
from tests.llm import brute
from tests.llm.test_contracts import check_packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Documents with everything that may be odd about them."""
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), None, None), (4, None, "en", "a"), (5, "", "en", "b"), (6, "   \n\t", "en", "b"),
        (7, "one two", "en", "b"), (8, "One TWO", "en", "b"), (None, words(30, 2), "en", "b"), (9, words(30_000, 3), "en", "c"), (10, "ü" * 500, "de", "c"), (11, "日本語 " * 200, "ja", "c"), (12, "a" * 700, "xx", "c"),
        (13, words(50, 4) + "\n" + base[:400] + "\n" + words(50, 5), "en", "d"), (14, "x\x00y \u2028 z", "en", "d"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, DOCS).withColumn("rows", F.lit(7)).withColumn("score", F.lit("x")).repartition(3, "doc_id")


def by_text(rows):
    """Documents with an id of their own, in row order."""
    return [(i, r[1]) for i, r in enumerate(rows)]


def test_contamination_odd(spark, docs, odd):
    items = [(1, " ".join(odd[0][1].split()[5:25])), (2, None), (3, ""), (4, "One two"), (None, "日本語 日本語"), (4, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminate([(r[0], r[1]) for r in odd], [("null" if i is None else i, t) for i, t in items])
    for block in (1 << 20, 200):  # one block, and several
        got = contamination.find(docs, bench, block_bytes=block)
        for r in got.collect():
            n_hit = sum(s["word_to"] - s["word_from"] for s in r["spans"])
            assert (r["n_words"], n_hit, len(r["items"])) == want[r["doc_id"]][:3]
        assert got.count() == len(odd)
    none = contamination.find(docs, bench.where("false"))
    assert none.where(F.size("spans") > 0).count() == 0
    assert contamination.find(docs.where("false"), bench).count() == 0
    cut = contamination.remove_spans(docs, bench)
    assert cut.columns == docs.columns
    left = brute.decontaminate([(i, r["text"]) for i, r in enumerate(cut.collect())], items)
    assert not any(v[1] for v in left.values())
    assert {r["doc_id"] for r in cut.collect()} == {r[0] for r in odd} - {7, 8, 11}


def test_fm_index_against_search():
    r = np.random.default_rng(1)
    seq = r.integers(0, 4, 3000)
    fm = contamination.FmIndex(seq, 4)
    pats = r.integers(1, 4, (200, 6))
    length = r.integers(1, 7, 200)
    sp, ep = fm.search(pats, length)
    for p, n, a, b in zip(pats, length, sp, ep, strict=True):
        want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p[:n]).all()]
        assert sorted(fm.locate(np.arange(a, max(a, b))).tolist()) == want


def test_embeddings_odd(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 16))
    rows = [(i, base[i % 40] + (r.normal(size=16) * (0.05 if i >= 40 else 0)), i % 2 if i < 60 else 0) for i in range(200)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], None), (203, None, 0), (204, [], 0), (205, [0.0] * 16, 0), (206, [float("nan")] + [1.0] * 15, 0), (207, [None] + [1.0] * 15, 0), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0), (210, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link(df).collect()}
    want = brute.vectors(rows)
    assert sum(v[0] for v in want.values()) > 50
    assert got == want
    assert embedding_dedup.link(df.where("false")).count() == 0
    same = embedding_dedup.link(df.where("vec_id >= 203 and vec_id < 208"))
    assert {r["n_links"] for r in same.collect()} == {0}


def test_embeddings_low_rank(spark):
    """Vectors of 768 components that vary in 12 directions only, in pairs that straddle list boundaries."""
    r = np.random.default_rng(11)
    basis = np.linalg.qr(r.normal(size=(768, 12)))[0].T
    base = r.normal(size=(1200, 12))
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = r.normal(size=base.shape)
    step *= 0.17 / np.linalg.norm(step, axis=1)[:, None]
    x = np.concatenate([base, base + step]) @ basis
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.link(df).collect()}
    assert want.sum() > 2000
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_token_ledger(spark, odd, tmp_path):
    docs = spark.createDataFrame(odd, DOCS)
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger", {"words": None})
    assert ledger.totals().count() == 0
    assert ledger.commit("one", token_counts.signed(inserts=docs))
    assert not ledger.commit("one", token_counts.signed(inserts=docs))
    total = sum(len((r[1] or "").encode().split()) for r in odd)
    assert ledger.totals().agg(F.sum("n_tokens"), F.sum("n_docs")).first() == (total, len(odd))
    change = docs.where("doc_id = 7").select(F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("text").alias("old_text"), F.lit("z").alias("source"), "lang", F.lit("one two three").alias("text"))
    assert ledger.commit("two", token_counts.signed(deletes=docs.where("doc_id = 9"), revised=change))
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    assert got[("z", "en")] == (1, 3)
    assert sum(v[1] for v in got.values()) == total - 30_000 + 1
    before = sorted(map(tuple, ledger.totals().collect()), key=str)
    ledger.compact(["one", "two"])
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == before
    assert not ledger.commit("two", token_counts.signed(inserts=docs))
    assert ledger.commit("empty", token_counts.signed(inserts=docs.where("false")))
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == before
    with pytest.raises(ValueError, match="batch id"):
        ledger.commit("a/b", token_counts.signed(inserts=docs))
    undo = token_counts.signed(deletes=docs.where("doc_id <> 9 or doc_id is null"), revised=None)
    assert undo.columns == ["source", "lang", "text", "sign"]


def test_token_ledger_crashes_and_races(spark, odd, tmp_path, monkeypatch):
    """Totals are right before, between and after the steps of a fold, and of several writers of one batch one counts."""
    import threading

    docs = spark.createDataFrame(odd, DOCS)
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger", {"words": None})

    def totals():
        return sorted(map(tuple, token_counts.TokenLedger(spark, ledger.path, ledger.tokenizers).totals().collect()), key=str)

    ledger.commit("one", token_counts.signed(inserts=docs))
    ledger.commit("two", token_counts.signed(inserts=docs))
    want = totals()
    append = token_counts.TokenLedger._append

    def dies(*_):
        assert totals() == want
        raise OSError("lost")

    monkeypatch.setattr(token_counts.TokenLedger, "_append", dies)
    for step in (ledger.compact, lambda: ledger.commit("three", token_counts.signed(inserts=docs))):
        with pytest.raises(OSError, match="lost"):
            step()
        assert totals() == want
    monkeypatch.setattr(token_counts.TokenLedger, "_append", append)
    assert ledger.compact() and totals() == want and not ledger.compact()
    assert not ledger.commit("one", token_counts.signed(inserts=docs))
    # several writers have seen the same state before any of them has written
    barrier, done = threading.Barrier(4, timeout=100), []
    state = token_counts.TokenLedger._state

    def same(self):
        out = state(self)
        if out.n == 3:
            barrier.wait()
        return out

    monkeypatch.setattr(token_counts.TokenLedger, "_state", same)
    writers = [threading.Thread(target=lambda: done.append(ledger.commit("four", token_counts.signed(inserts=docs)))) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    monkeypatch.setattr(token_counts.TokenLedger, "_state", state)
    assert sorted(done) == [False, False, False, True]
    assert [r[4] for r in totals()] == [3 * r[4] // 2 for r in want]
    assert ledger.clean() == 4 and len(ledger._state().live) == 2  # two folded, two lost
    for by_link in (True, False):
        place = f"file://{tmp_path}/new-{by_link}"
        assert work.create(spark, place, "a", by_link) and not work.create(spark, place, "b", by_link) and work.read_text(spark, place) == "a"


def test_token_ledger_snapshots(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "SNAPSHOT", 3)
    docs = spark.createDataFrame(odd[:2], DOCS)
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger", {"words": None})
    for i in range(7):
        assert ledger.commit(f"b{i}", token_counts.signed(inserts=docs))
        assert not ledger.commit(f"b{i // 2}", token_counts.signed(inserts=docs))
    assert len(ledger._state().live) == 7 and ledger.compact() and len(ledger._state().ids) == 7
    assert ledger.totals().agg(F.sum("n_docs")).first()[0] == 14


def test_token_query_runs_signed_deltas(spark, sf_dir, monkeypatch):
    """The registered query revises every row and deletes some, and ends with the plain totals."""
    from strandline.llm import queries

    signs, ledgers = {}, []
    commit = token_counts.TokenLedger.commit

    def watched(self, batch_id, rows):
        ledgers.append(self)
        signs.setdefault(batch_id, {r["sign"]: r["count"] for r in rows.groupBy("sign").count().collect()})
        return commit(self, batch_id, rows)

    monkeypatch.setattr(token_counts.TokenLedger, "commit", watched)
    got = queries.op3_token_counts(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    assert {-1: n, 1: n} in signs.values()
    assert any(set(s) == {-1} and 0 < s[-1] < n for s in signs.values())
    plain = token_counts.TokenLedger(spark, work.Scratch(spark, "t").root, ledgers[0].tokenizers)
    commit(plain, "load", token_counts.signed(inserts=docs.select("source", "lang", "text")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.rollup().collect()), key=str)


def digests(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removal_digest(df, **options).collect()}


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_odd(spark, odd, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    line = words(12, 77)[:70]
    rows = by_text([r for r in odd if r[0] != 9]) + [(100 + i, f"{words(25, 200 + i)} {line} {words(25, 300 + i)}") for i in range(12)] + [(200 + i, words(40, 400)[:180] + words(40, 500 + i % 3)) for i in range(9)]
    assert digests(spark, rows) == brute.repeats(rows)
    assert digests(spark, rows, length=40) == brute.repeats(rows, 40)


def test_suffix_keep_first(spark, odd):
    base = odd[0][1]
    rows = [(0, base), (1, base), (2, words(40, 8) + base[100:420] + words(40, 9)), (3, base[150:] + base[:300]), (4, "a" * 700), (5, "é" * 300 + base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("rows", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove(df).collect()}
    want = brute.repeats(rows, keep_first=True)
    for d, text in rows:
        # cuts move inward to whole characters
        assert 0 <= len(got[d].encode()) - (want[d][0] - want[d][1]) <= 2 * want[d][2]
    assert got[0] == base
    assert got[1] == ""
    odd_df = spark.createDataFrame(odd, DOCS)
    kept = suffix_dedup.remove(odd_df)
    assert kept.columns == odd_df.columns
    assert kept.count() == len(odd)
    assert kept.where("doc_id = 4 and text is null").count() == 1
    assert suffix_dedup.remove(odd_df.where("false")).count() == 0


def test_quality_odd(spark, docs, odd):
    labels = spark.createDataFrame([(1, 1), (9, 1), (12, 0), (11, 0), (10, 0), (3, 1), (None, 1), (13, None)], "doc_id long, quality int")
    ranker = quality.train(docs.select("doc_id", "text"), labels)
    got = quality.score(docs, ranker).collect()
    assert len(got) == len(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert set(docs.columns) <= {*quality.score(docs, ranker).columns, "score"}
    alone = quality.train(docs.select("doc_id", "text"), labels.where("quality = 1"))
    assert {r["score"] for r in quality.score(docs, alone).collect()} == {0.5}
    assert quality.score(docs.where("false"), ranker).count() == 0


def test_toxicity_odd(spark, docs, odd):
    rows = [(i, words(20, i) + (" vilewordx" if i % 4 == 0 else ""), 1, int(i % 4 == 0)) for i in range(1000, 1200)]
    lab = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    train = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    chain = toxicity.train(train.unionByName(docs.select("doc_id", "text")), lab)
    got = toxicity.score(docs.unionByName(docs.limit(1).withColumn("text", F.lit("so VileWordX!")).withColumn("doc_id", F.lit(99).cast("long"))), chain)
    assert set(docs.columns) <= set(got.columns)
    assert {r["doc_id"] for r in got.where("rejected").collect()} == {99}
    none = toxicity.train(docs.select("doc_id", "text"), lab.where("false"))
    assert toxicity.score(docs, none).where("rejected or p_toxic > 0").count() == 0
    assert toxicity.score(docs.where("false"), chain).count() == 0


def test_urls_odd(spark):
    urls = [None, "", "no scheme", "HTTP://Sub.EXAMPLE.org/es/x?y#z", "http://example.org", "http://example.org?/es/", "http://notexample.org/es/", "a://b.org://c/d", "http://x.com/fr/a", "http://x.com/de/", "http://com/de/", "http:///path", "http://y.net/q"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/de/", "allow"), (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")

    def expect(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
            host, path = rest[:n].lower(), rest[n:]
            path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
        best = None
        for h, p, v in [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]:
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
                best = (h + p, v)
        return (host, path, *(best or (None, "allow")))

    for limit in (url_filter.MAX_BROADCAST_BLOCKS, 0):  # broadcast, and shuffled
        url_filter.MAX_BROADCAST_BLOCKS, old = limit, url_filter.MAX_BROADCAST_BLOCKS
        try:
            got = url_filter.filter_urls(pages, rules).collect()
        finally:
            url_filter.MAX_BROADCAST_BLOCKS = old
        assert len(got) == len(urls) + 1
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == expect(urls[r["page_id"]])
    assert url_filter.filter_urls(pages, rules.where("false")).where("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0


def test_long_document_in_pieces():
    """A document searched in pieces has the spans and items of the whole."""
    import pyarrow as pa

    r = random.Random(3)
    text = " ".join(r.choice(["ab", "c", "ab", "é", "long" * 9]) + r.choice(["", ".", " "]) for _ in range(9000))
    w = text.replace(".", " ").split()
    item = [" ".join(w[i : i + 20]) for i in (5, 1000, 1012, 4000, 8970)] + ["c"]
    p = contamination.Phrases([str(i) for i in range(6)], pa.array(item), 13)
    data, off = contamination.text_bytes(pa.array([text]))
    n, spans, items = contamination._search_shard(data, off, p)
    assert len(spans[0]) > 100 and len(items[0]) == 6
    for size in (300, 4000):
        n2, spans2, items2 = contamination._search(data, off, p, size)
        assert (n2.tolist(), [tuple(x) for x in spans2[0]], items2) == (n.tolist(), [tuple(x) for x in spans[0]], items)


def test_suffix_pieces():
    """The pieces of a long chunk have each window once, and none across documents."""
    n = 2 * suffix_dedup.CHUNK
    data = np.random.default_rng(1).integers(0, 255, 3 * n + 150, np.uint8)
    off = np.array([0, 100, 100, n + 300, 3 * n, 3 * n + 150])
    seen = np.zeros(len(data), int)
    for at, part, bounds in suffix_dedup.pieces(data, off, 200):
        assert (part == data[at : at + len(part)]).all()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            seen[at + a : max(at + a, at + b - 199)] += 1
    want = np.zeros(len(data), int)
    for a, b in zip(off[:-1], off[1:], strict=True):
        want[a : max(a, b - 199)] = 1
    assert (seen == want).all()


def test_urls_ties_and_names(spark):
    pages = spark.createDataFrame([(1, "http://x.org/abcd", "p", "q"), (2, "http://q.org/", "p", "q")], "page_id long, url string, row string, whole string")
    rules = spark.createDataFrame([("org", "/abcd", "allow"), ("x.org", "/ab", "block"), ("Q.ORG", "", "block")], "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.filter_urls(pages, rules).select("page_id", "row", "whole", "rule", "verdict").collect()))
    assert got == [(1, "p", "q", "x.org/ab", "block"), (2, "p", "q", "q.org", "block")]  # as long, and a longer host
    same = spark.createDataFrame([("org", "/abcd", "allow"), ("x.org", "/abx", "block"), ("x.org", "/abc", "allow"), ("org", "/abcdxx", "block")], "host string, path string, verdict string")
    assert url_filter.filter_urls(pages, same).where("page_id = 1").select("rule", "verdict").first() == ("x.org/abc", "allow")


def test_urls_long_list(spark):
    """Whether the list has a thousand rules or many more, the verdicts are those of the plain join."""
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 700, '.net/p', id) as url")
    for n in (1000, 60_000):
        rules = spark.range(n).selectExpr("concat('h', id, '.net') as host", "concat('/p', id) as path", "'block' as verdict")
        got = url_filter.filter_urls(pages, rules)
        want = pages.where(f"exists(sequence(0, 0), x -> page_id % 700 < {n} and startswith(concat('p', page_id), concat('p', page_id % 700)))").count()
        assert got.where("verdict = 'block'").count() == want
        assert got.count() == 3000


def test_html_odd(spark):
    menu = "<div>Home | News | About us</div>"
    foot = "<p>All rights of this page belong to nobody at all</p>"
    pages = [
        (1, "http://h/a/1", f"<html><body>{menu}<p>First story &amp; more</p>{foot}"), (2, "http://h/a/2", f"<html><body>{menu}<p>Second story<br>goes on</p><p>With two parts</p>{foot}</body>"), (3, "http://h/a/3", f"<body>{menu}<p>Third story</p>{foot}"),
        (4, None, None), (5, "http://h/b", ""), (6, "http://z/x", "<article><header><h1>T</h1></header><p>One<p>Two&nbsp; &lt;b&gt;</p><script>var a='</p>'</script><section class='comments'><p>bad</p></section><aside>no</aside></article><footer>f</footer>"),
        (7, "http://z/y", "<main><div class=\"share-bar share\"><p>no</p></div><p>Yes <i>in</i>line</p><form><input><p>no</p></form></main"), (8, "http://q/1", "<p>copy one</p><p>copy two</p>"), (9, "http://q/2", "<p>copy one</p><p>copy two</p>"), (10, "u", "<p>open <b>never closed"), (11, "u2", "<!-- <p>x</p> --><style>p{}</style>plain"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)).coalesce(1)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {1: "First story & more", 2: "Second story goes on\nWith two parts", 3: "Third story", 4: "", 5: "", 6: "One\nTwo <b>", 7: "Yes inline", 8: "copy one\ncopy two", 9: "copy one\ncopy two", 10: "open never closed", 11: "plain"} | {6: got[6]}
    assert got[6].endswith("One\nTwo <b>")
    assert html_extract.extract(df.where("false")).count() == 0


def test_html_marks_by_parser(spark):
    story = "<div><p>The story stands in plain blocks and is much longer than any card</p></div>"
    pages = [
        (1, "http://a/1", f"<!-- <article> -->{story}"),
        (2, "http://b/1", f"<script>var t = '<article>';</script>{story}"),
        (3, "http://c/1", f"<div data-role=\"main\"></div>{story}"),
        (4, "http://d/1", f"<div role=maintenance>{story}</div>"),
        (5, "http://e/1", f"{story}<article class='comment'><p>me too</p></article>"),
        (6, "http://f/1", f"<article><p>Teaser</p></article>{story}<article><p>Other</p></article>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    text = "The story stands in plain blocks and is much longer than any card"
    assert got == dict.fromkeys(range(1, 6), text) | {6: f"Teaser\n{text}\nOther"}


def test_html_neighbours(spark):
    """Copies are passed over, long templates are not taken for copies, and ranges' edges hide no neighbour."""
    menu = [f"Menu entry {i}" for i in range(10)]
    pages, want = [], {}

    def add(url, shared, own):
        want[len(pages)] = "\n".join(own)
        pages.append((len(pages), url, "".join(f"<p>{t}</p>" for t in shared + own)))

    for i in range(12):  # three copies and more of each article in turn
        add(f"http://copies/{i:03}", menu, [f"Story {i // 4} line {k}" for k in range(50)] + [f"Printed {i}"] * (i % 4 == 1))
    heavy = [f"Template line {k}" for k in range(40)]
    for i in range(6):
        add(f"http://heavy/{i:03}", heavy, [f"Own {i} line {k}" for k in range(8)])
    for i in range(30):
        add(f"http://pair{i}/a", menu, [f"First {i} line {k}" for k in range(5)])
        add(f"http://pair{i}/b", menu, [f"Second {i} line {k}" for k in range(5)])
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for spread in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", spread)
        try:
            got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        assert got == want


def test_html_inline_parts(spark):
    """Dropped parts inside a block do not split it; a class name alone does not end a block either."""
    pages = [(1, "http://a/1", "<p>one <button>b</button> two<script>var x;</script> three</p>"), (2, "http://b/1", "<article><p>a <select><option>x</select> b</p><p>c</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == {1: "one two three", 2: "a b\nc"}


@pytest.mark.parametrize("mark", ["article", "div"])
def test_html_template_in_the_article(spark, mark):
    """Blocks that all pages of a host share go, in marked articles as well; a sentence of a few pages stays."""
    notice = "<p>Please support this site</p>"
    body = [[f"Page {i} line {k}" for k in range(12)] + ["A common sentence."] * (i % 4 == 0) for i in range(24)]
    pages = [(i, f"http://site/{i:02}", f"<{mark}>{notice}{''.join(f'<p>{t}</p>' for t in b)}</{mark}>") for i, b in enumerate(body)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {i: "\n".join(b) for i, b in enumerate(body)}


def test_html_long_host(spark, monkeypatch):
    """A host that is held in parts gives the same texts."""
    pages = [(i, f"http://site/{i:04}", f"<div>Menu</div><p>Own text {i}</p><p>Group {i // 300}</p><div>Foot</div>") for i in range(1500)]
    from strandline.llm.html_extract import _DONE, _OPEN, _difference, lines

    monkeypatch.setattr(html_extract, "HELD", 20_000)
    rows = ((i, u, "site", u, *lines(h), _OPEN) for i, u, h in pages)
    got = {r["page_id"]: r["text"] for b in _difference(rows, False, 0.8, 0.1) for r in b.to_pylist() if r["kind"] == _DONE}
    assert got.keys() == {p[0] for p in pages}
    for i, text in got.items():
        edge = min(i % 300, 299 - i % 300)  # beside another group the last group's line is shared on one side only
        assert text == f"Own text {i}" or edge < 4


@pytest.mark.parametrize("held", [1 << 40, 20_000])
@pytest.mark.parametrize("cuts", [[], [1, 2, 340, 700, 701, 1100]])
def test_html_whatever_the_parts(monkeypatch, held, cuts):
    """Texts depend neither on how much of a host is held at a time nor on how its pages are dealt out."""
    menu = ["Home", "News", "About"]
    rows, want = [], {}
    for i in range(1200):
        copy, heavy = 200 <= i < 800, i >= 1000  # 600 near copies in a row; a host whose template is far longer than its articles
        shared = menu + [f"Template {k}" for k in range(40)] if heavy else menu
        own = [f"Story line {k}" for k in range(30)] + [f"Printed {i}"] if copy else [f"Page {i} line {k}" for k in range(6)]
        host = "site" if i < 1000 else "wordy"
        rows.append((i, f"http://{host}/{i:04}", host, f"/{i:04}", shared + own, False, html_extract._OPEN))
        want[i] = "\n".join(own)
    monkeypatch.setattr(html_extract, "HELD", held)

    def step(part, ends_open):
        return [r for b in html_extract._difference(iter(part), ends_open, 0.8, 0.1) for r in b.to_pylist()]

    done, edges, open_ = [], {}, set()
    for at, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        for r in step(rows[a:b], bool(cuts)):
            if r["kind"] == html_extract._DONE:
                done.append(r)
            else:  # an edge's pages meet; here those of all edges that ranges join
                edges.setdefault(at + r["edge"], []).append(r)
                open_ |= {at} if r["joins"] else set()
    for e in sorted(open_):
        edges[e + 1] = edges.pop(e) + edges.get(e + 1, [])
    for e in edges.values():
        done += step([tuple(r[c] for c in ("page_id", "url", "host", "path", "lines", "marked", "kind")) for r in sorted(e, key=lambda r: r["page_id"])], False)
    assert len(done) == len(rows)
    assert {r["page_id"]: r["text"] for r in done} == want


def test_lcs_against_table():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        hit = html_extract.shared(a, b)
        assert hit.sum() == t[-1][-1]
        it = iter(b)
        assert all(x in it for x, h in zip(a, hit, strict=True) if h)


@pytest.mark.parametrize("block", [400_000, 300])
def test_minhash_odd(spark, odd, docs, block, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "FAMILY_BLOCK", block)
    base = words(100, 50).split()
    rows = [(r[0], r[1]) for r in odd if r[0] is not None and r[0] != 2] + [(2, odd[1][1])]
    for i in range(40):
        w = list(base)
        for k in range(i % 4):
            w[(i * 7 + k * 13) % 100] = f"edit{i}x{k}"
        rows.append((300 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (85, 80):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.classes(df, percent).collect()}
        assert got == brute.near(rows, percent)
    kept = minhash_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted((r[0] or 0) for r in odd if r[0] not in (2, 3, 8))
    assert minhash_dedup.classes(docs.where("false"), 85).count() == 0


@pytest.mark.parametrize("block", [2048, 500])
def test_minhash_unlike_bucket(spark, block, monkeypatch):
    """Planted pairs in one bucket of thousands of unlike documents."""
    monkeypatch.setattr(minhash_dedup, "BUCKET_BLOCK", block, raising=False)
    r = np.random.default_rng(8)
    sketch = r.integers(0, 256, (3000, 48), np.uint8)
    pairs = [(i, 1500 + 7 * i) for i in range(0, 200, 5)]
    for a, b in pairs:
        sketch[b] = sketch[a]
        sketch[b, r.choice(48, 10, replace=False)] = r.integers(0, 256, 10)
    rows = [(i, [1, *(10_000 * j + i for j in range(1, 8))], [2, *(10_000 * j + i for j in range(1, 8))], bytearray(s.tobytes())) for i, s in enumerate(sketch)]
    sig = spark.createDataFrame(rows, "doc_id long, left array<long>, right array<long>, sketch binary")
    scratch = work.Scratch(spark, "t")
    got = {x["node"]: x["component"] for x in work.components(minhash_dedup._candidates(sig, scratch, 0.85, 8, 3)[1], scratch).collect()}
    assert got == {x: a for a, b in pairs for x in (a, b)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in work.components(df, work.Scratch(spark, "t")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert work.components(df.where("false"), work.Scratch(spark, "t")).count() == 0


def test_packing_odd(spark, odd, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in by_text(odd)] + [(50, "a<|endoftext|>b"), (51, "it's  'quoted'  \n\n end "), (52, "½ ² ª µ \x1f \x85 \u3000 x_y"), (53, "Größe 123abc")]
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack_documents(df, path, keep_ids=True)
    check_packing(got.collect(), ids)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got.collect())
    small = packing.pack_documents(df, path, size=16, open_windows=2, min_cut=2)
    assert small.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 16
    assert packing.pack_documents(docs, path).count() >= len(odd)
    assert packing.pack_documents(df.where("false"), path).count() == 0


def test_span_hash_is_by_content():
    data = np.frombuffer(b"abcabcabx", np.uint8)
    h = hashing.SpanHash(data)
    at = np.array([0, 3, 6])
    a, b, c = h(at, at + 3)
    assert a == b != c


STAGE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __row string, __null boolean, __gone string, row string, spans string, n_words string, rejected string, p_toxic string, gone string, kept string"


def test_pipeline_edges(spark, sf_dir, odd):
    """Every stage keeps nulls, repeated rows and columns with clashing names, and takes an empty table."""
    import corpus_pipeline

    rows = [(r[0], r[1], "en", "s", 1, *[f"{i}"] * 1, True, *[f"x{k}" for k in range(8)]) for i, r in enumerate(odd)]
    df = spark.createDataFrame(rows, STAGE_COLUMNS).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, df, sf_dir)
        assert got.columns == df.columns, name
        kept = {tuple(r)[5]: r for r in got.collect()}
        for r in df.collect():
            if r["__row"] in kept:
                same = kept[r["__row"]]
                assert [same[c] for c in df.columns if c != "text"] == [r[c] for c in df.columns if c != "text"], name
        assert any(r["doc_id"] is None for r in kept.values()) == any(r[0] is None for r in odd), name
        assert stage(spark, df.where("false"), sf_dir).count() == 0, name
    packed = corpus_pipeline.STAGES[4][1](spark, df, sf_dir)
    assert packed.select("doc_id", "doc_tokens").count() >= len(odd)
    assert corpus_pipeline.STAGES[4][1](spark, df.where("false"), sf_dir).count() == 0


def test_labels_of_repeated_ids(spark):
    """A labelled id that many rows have is learned from once, so what comes to the driver stays bounded."""
    docs = spark.range(4000).selectExpr("0L as doc_id", "concat('same words ', id) as text").union(spark.createDataFrame([(1, "other thing"), (2, "third thing")], "doc_id long, text string"))
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    assert len(chain.models) == 3
    assert toxicity.score(docs, chain).where("rejected").select("doc_id").distinct().count() <= 1
    assert quality.score(docs, quality.train(docs, labels)).count() == 4002


def test_ranker_against_plain_descent():
    """The fitted ranking is that of plain gradient descent on the pairs' logistic loss."""
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 5))
    y = (x @ np.array([1.0, -2, 0.5, 0, 0]) + r.normal(size=300) > 0).astype(int)
    ranker = quality.Ranker().fit(x, y)
    z = ranker._wide(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(7)
    n = quality.PAIRS_PER_DOC
    win = np.concatenate([np.repeat(good, n), rng.choice(good, len(bad) * n)])
    lose = np.concatenate([rng.choice(bad, len(good) * n), np.repeat(bad, n)])
    d = z[win] - z[lose]
    w = np.zeros(z.shape[1])
    for _ in range(4000):
        w -= 0.5 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(0) + 1e-3 * w)
    want = 1 / (1 + np.exp(-(z @ w - np.quantile(z @ w, len(bad) / 300))))
    assert np.abs(ranker.score(x) - want).max() < 0.02


def test_quality_learns_from_every_label(spark):
    """Model and cut are those of all labelled documents and all their pairs, also beyond 20,000 of them."""
    n = 21_000
    texts = [words(1 + i % 7, i) + (" #$ 12 12 12" if i % 300 == 0 else " End." * (i % 4)) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ranker = quality.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 150 != 0 as int) as quality"))
    x = quality.features(*hashing.text_bytes(quality.pa.array(texts)))
    y = np.arange(n) % 150 != 0
    assert np.allclose(ranker.mean, x.mean(0), rtol=0, atol=1e-9)
    z = ranker._wide(x)
    slope, s = 1e-3 * ranker.w, z @ ranker.w
    for i in np.flatnonzero(~y):  # the slope of the loss over all pairs
        slope -= (z[y] - z[i]).T @ (1 / (1 + np.exp(s[y] - s[i]))) / (y.sum() * (~y).sum())
    assert np.abs(slope).max() < 1e-6
    q = (~y).mean()
    assert abs(ranker.cut - np.quantile(s, [max(0, q - 0.005), q + 0.005]).mean()) < 1e-6


def test_chain_against_plain_descent(monkeypatch):
    """Each link of the chain is a logistic regression over its slots and the links before, as plain descent fits it."""
    from strandline.llm.linear import Rows

    monkeypatch.setattr(toxicity, "LEAST_TEXTS", (1,))
    r = np.random.default_rng(6)
    dense = (r.random((400, 12)) < 0.3).astype(float)
    y = np.stack([dense[:, 0] > 0, (dense[:, 1] + dense[:, 2] > 1) | (r.random(400) < 0.05)], 1).astype(int)
    row, col = np.nonzero(dense)
    rows = Rows(col.astype(np.int64), np.ones(len(col)), np.searchsorted(row, np.arange(401)))
    chain = toxicity.Chain(["junk", "toxic"], 4, ("toxic",)).fit(rows, y, np.arange(400) % 4, strengths=(1e-2,))
    slots, w, v = chain.models[1]
    # the first link's out-of-fold probabilities, fitted plainly
    def descend(a, t, l2, free):
        weight = np.where(t == 1, min(10.0, (len(t) - t.sum()) / t.sum()), 1.0)
        u = np.zeros(a.shape[1])
        reg = np.full(a.shape[1], l2)
        reg[-1] = 0
        for _ in range(20_000):
            u -= 0.5 * (a.T @ (weight * (1 / (1 + np.exp(-a @ u)) - t)) / weight.sum() + reg * u)
        return u

    first = chain.models[0][0]
    one = np.ones((400, 1))
    oof = np.zeros(400)
    for f in range(4):
        a, b = np.arange(400) % 4 != f, np.arange(400) % 4 == f
        keep = toxicity._telling(rows.pick(a), y[a, 0].astype(float), 16)
        u = descend(np.hstack([dense[a][:, keep], one[a]]), y[a, 0], 1e-2, 1)
        oof[b] = 1 / (1 + np.exp(-np.hstack([dense[b][:, keep], one[b]]) @ u))
    u = descend(np.hstack([dense[:, slots], oof[:, None], one]), y[:, 1], 1e-2, 1)
    assert len(first) and np.abs(np.concatenate([w, v]) - u).max() < 0.05


@pytest.mark.parametrize("rows", [500_000, 60])
def test_components_in_parts(spark, rows, monkeypatch):
    """One part or many: the components are those of a plain union."""
    monkeypatch.setattr(work, "ROWS_A_FILE", rows)
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 300)] + [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(220)] + [(5000 + i, 4000) for i in range(50)] + [(7, 7), (None, 3), (1, 0), (0, 1)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {x["node"]: x["component"] for x in work.components(df, work.Scratch(spark, "t")).collect()}
    plain = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == brute.roots(sorted({x for e in plain for x in e}), plain)
    assert work.components(df.where("false"), work.Scratch(spark, "t")).count() == 0
