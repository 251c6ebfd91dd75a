"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

Each distinct shingle set gets two collections of ``m`` half keys, each half key made from ``rows`` minhashes.
A table's key joins one half key of each collection, so ``m * m`` tables cost ``2 * m * rows`` minhashes. Then:

1. in each bucket, everyone is paired with the member of the smallest hash, its lead; pairs whose minhashes agree
   too seldom for the threshold are dropped, and members whose pair is dropped meet all others of their bucket,
   in blocks of bounded size. So each two members of a bucket either agree too seldom or are in one *family*, a
   component of pairs that may link;
2. each member's full set is compared with that of the best lead it agrees with: one exact test a member, which
   joins a group of near copies of any size in linear time;
3. families that are still in several parts have every member outside of the largest part compared exactly with
   all members of other parts, in blocks of bounded size. Two sets that are linked already are not compared.

Exact tests send spanning links, not all pairs. A family's blocks are spread over tasks.

Edge cases: null and empty texts, and texts without words, have an empty set, link with nothing and are
kept; a null id is never linked, has a null component and is kept; rows that repeat an id share its
component; a text of fewer words than a shingle is one shingle. Extra columns of any name are kept by ``dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.hashing import LOWER, SpanHash, blocks, mix, text_bytes, words
from strandline.llm.stream import groups
from strandline.llm.work import Scratch, components, lean

WORDS, COLLECTION, ROWS, BLOCK = 5, 8, 3, 1 << 20
#: Shingles, and members, of a block of a group; a larger group is compared block by block.
FAMILY_BLOCK, FAMILY_MEMBERS = 400_000, 8192
#: Members of a block of a bucket, on both sides.
BUCKET_BLOCK = 2048
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_RNG = np.random.default_rng(20_240_101)
_A = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, 256, np.uint64)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, one after the other, and their bounds (texts + 1)."""
    low = LOWER[data]
    s, e, first = words(low, off, _WORD)
    h = SpanHash(low)(s, e)
    n_words = np.diff(first)
    n_sh = np.where(n_words == 0, 0, np.maximum(1, n_words - n + 1))
    start = np.concatenate([[0], np.cumsum(n_sh)])
    doc = np.repeat(np.arange(len(n_sh)), n_sh)
    at = first[doc] + np.arange(start[-1]) - start[doc]
    stop = first[doc + 1]
    v = np.zeros(len(at), np.uint64)
    padded = np.append(h, np.zeros(n, np.uint64))
    for k in range(n):
        here = at + k < stop
        v = v * np.uint64(0x9FB21C651E98DF25) + np.where(here, mix(padded[at + k] + np.uint64(k + 1)), np.uint64(0))
    v = mix(v + np.minimum(n_words[doc], n).astype(np.uint64))
    parts = [np.unique(v[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), bounds


def minhashes(v: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k minhashes of each set (none may be empty)."""
    return np.stack([np.minimum.reduceat(v * _A[i] + _B[i] ^ (v >> np.uint64(29)), bounds[:-1]) for i in range(k)], 1)


_SIG = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("sketch", pa.binary())])
_SIG_SQL = "doc_id long, n_shingles long, set1 long, set2 long, left array<long>, right array<long>, sketch binary"


def signatures(docs: DataFrame, n_words: int, m: int, rows: int) -> DataFrame:
    """One row for each document: size and hash of its set, half keys of both collections, one byte of each minhash."""

    @lean
    def run(batches):
        for b in blocks(batches, 1, BLOCK):
            v, bounds = shingle_sets(*text_bytes(b.column(1)), n_words)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            cuts = np.append(bounds[:-1][full], len(v))
            k = 2 * m * rows
            if len(full):
                mh = mix(minhashes(v, cuts, k))
                half = np.zeros((len(full), 2 * m), np.uint64)
                for r in range(rows):
                    half = mix(half * np.uint64(3) + mh[:, r::rows])
                set1 = np.add.reduceat(mix(v), cuts[:-1])
                set2 = np.add.reduceat(mix(v ^ np.uint64(0x5851F42D4C957F2D)), cuts[:-1])
                sketch = (mh & np.uint64(255)).astype(np.uint8)
            out: list[list] = [[None] * b.num_rows for _ in range(5)]
            for i, d in enumerate(full.tolist()):
                out[0][d], out[1][d] = int(set1[i].view(np.int64)), int(set2[i].view(np.int64))
                out[2][d], out[3][d] = half[i, :m].view(np.int64), half[i, m:].view(np.int64)
                out[4][d] = sketch[i].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), *(pa.array(c, f.type) for c, f in zip(out, list(_SIG)[2:], strict=True))], schema=_SIG)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SIG_SQL)


def _order(doc: str) -> Column:
    return F.xxhash64(doc, F.lit("lead"))


def _candidates(sig: DataFrame, scratch: Scratch, threshold: float, m: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(member, lead) that may link, and (a, b): pairs that span the families of all that may."""
    k = 2 * m * rows
    least = int(np.floor(k * threshold - 4.5 * np.sqrt(k * threshold * (1 - threshold))))
    half = sig.select("doc_id", F.posexplode("left").alias("i", "a"), "right").select("doc_id", "i", "a", F.posexplode("right").alias("j", "b"))
    keys = half.select(F.xxhash64("a", "b", "i", "j").alias("key"), "doc_id")
    lead = keys.groupBy("key").agg(F.count("*").alias("n"), F.min_by("doc_id", _order("doc_id")).alias("lead")).where("n > 1").select("key", "lead")
    # both sides grow with the corpus: never a broadcast, whatever a small table would allow
    members = scratch.save(keys.join(lead.hint("merge"), "key").select("key", F.col("doc_id").alias("a"), F.col("lead").alias("b")), "members")
    pairs = members.where("a <> b").select("a", "b").distinct()
    sketch = sig.select("doc_id", "sketch")
    both = pairs.join(sketch.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), "a").join(sketch.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ok", pa.bool_())])

    @lean
    def agree(batches):
        for t in batches:
            if t.num_rows:
                x = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(-1, k)
                y = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(-1, k)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array((x == y).sum(1) >= least)], schema=schema)

    met = scratch.save(both.mapInArrow(agree, "a long, b long, ok boolean"), "met")
    apart = members.join(met.where("not ok").select("a", "b"), ["a", "b"], "left_semi").select("key", F.col("a").alias("doc_id"))
    apart = scratch.save(apart.withColumn("apart", F.lit(True)), "apart")
    edges = _apart_links(members.select("key", F.col("a").alias("doc_id")), apart, sketch, k, least)
    ok = met.where("ok").select("a", "b")
    edges = scratch.save(ok.union(edges), "may-link")
    best = scratch.save(ok.groupBy("a").agg(F.min_by("b", _order("b")).alias("lead")).select(F.col("a").alias("member"), "lead"), "leads")
    for done in (members, met, apart):
        scratch.drop(done)
    return best, edges


def _apart_links(members: DataFrame, apart: DataFrame, sketch: DataFrame, k: int, least: int) -> DataFrame:
    """(a, b): links that span what ``apart(key, doc_id, apart)`` and the other members of their buckets agree on."""
    load = apart.groupBy("key").agg(F.count("*").alias("q"))
    rows = members.select("key", "doc_id").join(load, "key").join(apart, ["key", "doc_id"], "left").join(sketch, "doc_id")
    size = members.join(load, "key", "left_semi").groupBy("key").agg(F.ceil(F.count("*") / BUCKET_BLOCK).alias("bm"))
    rows = rows.join(size, "key").select("key", "doc_id", "sketch", F.coalesce("apart", F.lit(False)).alias("apart"), "bm", F.ceil(F.col("q") / BUCKET_BLOCK).alias("bq"))
    # a bucket of one block is its own other side; in a larger one, members apart go to a side of their own, too
    sides = F.when(F.col("apart") & (F.col("bm") > 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("side", F.explode(sides))
    mine, theirs = (F.when(F.col("side") == 0, F.col(x)).otherwise(F.col(y)) for x, y in (("bm", "bq"), ("bq", "bm")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), mine)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1)))
    at = [F.when(F.col("side") == 0, F.col(x)).otherwise(F.col(y)) for x, y in (("own", "other"), ("other", "own"))]
    ask = (F.col("side") == 1) | (F.col("apart") & (F.col("bm") == 1))
    rows = rows.select(F.xxhash64("key", *at).alias("cell"), "key", F.col("side").cast("long").alias("side"), "doc_id", ask.alias("ask"), "sketch")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "key", "side", "doc_id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    big = np.iinfo(np.int64).max

    @lean
    def compare(batches):
        for g in groups(batches, 2):
            x = np.frombuffer(b"".join(g["sketch"].to_pylist()), np.uint8).reshape(-1, k)
            ids, ask, side = g["doc_id"].to_numpy(), g["ask"].to_numpy(), g["side"].to_numpy()
            mid, y = ids[side == 0], np.ascontiguousarray(x[side == 0].T)
            qid, x = ids[ask], x[ask]
            linked = np.zeros((len(qid), len(mid)), bool)
            for i in range(0, len(qid), 256):
                n = np.zeros((len(x[i : i + 256]), len(mid)), np.uint8)
                for c in range(k):
                    n += x[i : i + 256, c, None] == y[c]
                linked[i : i + 256] = n >= least
            linked &= qid[:, None] != mid
            if not linked.any():
                continue
            rq, rm = qid.copy(), mid.copy()
            while True:
                nq = np.minimum(rq, np.where(linked, rm, big).min(1))
                nm = np.minimum(rm, np.where(linked, nq[:, None], big).min(0))
                if (nq == rq).all() and (nm == rm).all():
                    break
                rq, rm = nq, nm
            a, b = np.concatenate([qid, mid]), np.concatenate([rq, rm])
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], schema=schema)

    return rows.mapInArrow(compare, "a long, b long")


class Sets:
    """Some documents' ids, the parts that they are in, and their shingle sets one after the other."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray]):
        self.ids, self.parts = ids, parts
        self.size = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])


def spanning_links(ask: Sets, others: Sets, percent: int) -> list[tuple[int, int]]:
    """Links between ``ask`` and ``others`` that span what 100 * intersection >= percent * union joins of their parts."""
    flat, inv = np.unique(np.concatenate([ask.flat, others.flat]), return_inverse=True)
    mine, theirs = inv[: len(ask.flat)], inv[len(ask.flat) :]
    part = np.unique(np.concatenate([ask.parts, others.parts]), return_inverse=True)[1]
    root = np.arange(len(part))
    p_ask, p_all = part[: len(ask.ids)], part[len(ask.ids) :]
    there = np.zeros(len(flat), bool)
    there[theirs] = True
    # shingles that no set of the other side has cannot be common: without enough others, a set links with none
    common = np.add.reduceat(there[mine].astype(np.int64), ask.bounds[:-1])
    mark, out = np.zeros(len(flat), bool), []
    for i in np.flatnonzero(100 * common >= percent * ask.size).tolist():
        n = ask.size[i]
        near = np.flatnonzero((root[p_all] != root[p_ask[i]]) & (100 * others.size >= percent * n) & (percent * others.size <= 100 * n))
        if not len(near):
            continue
        own = mine[ask.bounds[i] : ask.bounds[i + 1]]
        mark[own] = True
        size = others.size[near]
        at = np.repeat(others.bounds[near] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        inter = np.add.reduceat(mark[theirs[at]].astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
        mark[own] = False
        for j in near[100 * inter >= percent * (n + size - inter)].tolist():
            a, b = root[p_ask[i]], root[p_all[j]]
            if a != b:
                root[root == max(a, b)] = min(a, b)
                out.append((int(ask.ids[i]), int(others.ids[j])))
    return out


def _verified(docs: DataFrame, groups_: DataFrame, percent: int, n_words: int) -> DataFrame:
    """(a, b): exact links that span the parts of each group.

    ``groups_(grp, doc_id, n_shingles, part, ask, other)``: in each group, sets with ``ask`` meet those with
    ``other``, in blocks on both sides; sets of one part are not compared.
    """

    def n_blocks(side):
        mine = F.when(F.col(side), F.col("n_shingles"))
        return F.greatest(F.ceil(F.sum(mine) / FAMILY_BLOCK), F.ceil(F.count(mine) / FAMILY_MEMBERS))

    load = groups_.groupBy("grp").agg(n_blocks("ask").alias("na"), n_blocks("other").alias("no")).where("na > 0 and no > 0")
    sides = F.filter(F.array(F.when(F.col("ask"), F.lit(1)), F.when(F.col("other"), F.lit(0))), lambda s: s.isNotNull())
    rows = groups_.join(load, "grp").withColumn("side", F.explode(sides))
    is_ask = F.col("side") == 1
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(is_ask, F.col("na")).otherwise(F.col("no"))))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_ask, F.col("no")).otherwise(F.col("na")) - 1)))
    cell = F.xxhash64("grp", F.when(is_ask, F.col("own")).otherwise(F.col("with")), F.when(is_ask, F.col("with")).otherwise(F.col("own")))
    meets = rows.groupBy("doc_id").agg(F.collect_list(F.struct(cell.alias("cell"), "grp", F.col("side").cast("long").alias("side"), "part")).alias("groups"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(meets.hint("merge"), "doc_id")
    kind = pa.list_(pa.struct([("cell", pa.int64()), ("grp", pa.int64()), ("side", pa.int64()), ("part", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("groups", kind), ("shingles", pa.binary())])

    @lean
    def reshingle(batches):
        for b in blocks(batches, 1, BLOCK):
            v, bounds = shingle_sets(*text_bytes(b.column(1)), n_words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(kind), pa.array([v[a:c].tobytes() for a, c in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], schema=schema)

    sets = texts.select("doc_id", "text", "groups").mapInArrow(reshingle, "doc_id long, groups array<struct<cell:long,grp:long,side:long,part:long>>, shingles binary")
    sets = sets.select("doc_id", "shingles", F.explode("groups").alias("g")).select("g.cell", "g.grp", "g.side", "g.part", "doc_id", "shingles")
    sets = sets.repartition("cell").sortWithinPartitions("cell", "grp", "side", "doc_id")
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @lean
    def verify(batches):
        for g in groups(batches, 2):
            side, ids, parts = g["side"].to_numpy(), g["doc_id"].to_numpy(), g["part"].to_numpy()
            raw = g["shingles"].to_pylist()
            new = np.ones(len(ids), bool)  # rows that repeat an id are one document
            new[1:] = (ids[1:] != ids[:-1]) | (side[1:] != side[:-1])
            ask, other = (np.flatnonzero(new & (side == k)) for k in (1, 0))
            if not len(ask) or not len(other):
                continue
            links = spanning_links(*(Sets(ids[at], parts[at], [np.frombuffer(raw[i], np.uint64) for i in at.tolist()]) for at in (ask, other)), percent)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=edge)

    return sets.mapInArrow(verify, "a long, b long")


def _parts(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """``edges(a, b)`` between the parts of ``comp(node, component)``, each once."""
    for side in ("a", "b"):
        edges = edges.join(comp.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part")), side, "left").withColumn(side, F.coalesce(f"{side}_part", side)).drop(f"{side}_part")
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(docs: DataFrame, distinct: DataFrame, scratch: Scratch, percent: int, n_words: int, m: int, rows: int) -> DataFrame:
    """(node, component) of the documents that link."""
    best, may = _candidates(distinct, scratch, percent / 100, m, rows)
    size = distinct.select("doc_id", "n_shingles")
    star = best.select(F.col("lead").alias("grp"), F.col("member").alias("doc_id"), F.lit(False).alias("ask"), F.lit(True).alias("other"))
    star = star.union(best.select(F.col("lead").alias("grp"), F.col("lead").alias("doc_id"), F.lit(True), F.lit(False)).distinct())
    star = star.join(size, "doc_id").select("grp", "doc_id", "n_shingles", F.col("doc_id").alias("part"), "ask", "other")
    first = components(_verified(docs, star, percent, n_words), scratch)
    between = scratch.save(_parts(may, first), "between")
    if between.isEmpty():
        return first
    family = components(between, scratch)
    # every document of a family, with the part that it is in
    part = family.select(F.col("node").alias("part"), F.col("component").alias("grp"))
    node = first.select(F.col("node").alias("doc_id"), F.col("component").alias("part")).union(part.join(first, F.col("part") == F.col("node"), "left_anti").select(F.col("part").alias("doc_id"), "part"))
    node = scratch.save(node.join(part, "part").join(size, "doc_id").select("grp", "doc_id", "n_shingles", "part"), "families")
    largest = node.groupBy("grp", "part").agg(F.sum("n_shingles").alias("n")).groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    asked = node.join(largest, "grp").withColumn("ask", F.col("part") != F.col("largest")).withColumn("other", F.lit(True)).drop("largest")
    found = scratch.save(_parts(_verified(docs, asked, percent, n_words), first), "more")
    if found.isEmpty():
        return first
    joined = components(found, scratch)
    after = first.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return after.union(joined.join(first, "node", "left_anti").select("node", "component"))


def classes(docs: DataFrame, percent: int = 80, n_words: int = WORDS, m: int = COLLECTION, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document; links need ``percent`` hundredths of similarity."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    sig = scratch.save(signatures(docs, n_words, m, rows), "signatures")
    # equal sets are one node, whatever their number
    rep = sig.where("n_shingles > 0 and doc_id is not null").groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    rep = scratch.save(rep, "sets")
    distinct = sig.join(rep.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    distinct = scratch.save(distinct.select("doc_id", "n_shingles", "left", "right", "sketch"), "distinct")
    comp = scratch.save(_links(docs, distinct, scratch, percent, n_words, m, rows), "components")
    scratch.drop(distinct)
    scratch.release()
    per_set = rep.join(comp, F.col("rep") == F.col("node"), "left").select("set1", "set2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    per_set = scratch.save(per_set, "classes")
    out = sig.select("doc_id", "n_shingles", "set1", "set2").join(per_set, ["set1", "set2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """``docs`` without the documents whose class has one of a smaller id; all columns stay.

    Rows that repeat an id of a kept document all stay: they are one document.
    """
    gone = classes(docs.select("doc_id", "text"), percent, **options).where("not kept").select(F.struct("doc_id").alias("gone")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.join(gone, F.col("row.doc_id") == F.col("gone.doc_id"), "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])
