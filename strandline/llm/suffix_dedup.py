"""Repeated passages by longest-previous-factor arrays, over shards of text that minimizers bring together.

Each 200-byte window of a document is routed by its minimizer, the smallest hash among its ``k``-byte
substrings, so equal windows meet wherever they are. Neighbouring windows with one minimizer travel as one
stretch of text, and equal stretches are one *type*:

1. minimizers that occur once in the corpus are dropped, and with them most of the text;
2. a type that occurs twice (by two 64-bit hashes, of the minimizer and of the whole stretch) repeats in all its
   windows; its first occurrence stands for it in what follows;
3. types that share a minimizer without being equal bring their text to one shard. Its suffixes are sorted
   (prefix doubling), with the common prefix of each with the one before; the previous and next entries of a
   smaller place in the corpus give each suffix's longest previous factor, the same arrays mirrored its longest
   later one. A window that reaches ``length`` bytes has an earlier, or a later, match;
4. a minimizer with more than ``HOT`` types (a line that a third of all documents share) is not gathered,
   so a group holds ``HOT`` stretches of less than two windows each at most, which is 1.6 MB: the rest is
   routed again by a longer ``k``, up to whole windows, of which each is one type.

So no group grows with the corpus, and nothing is capped or sampled. ``keep_first`` removes later copies
only; without it every copy goes.

Documents are handled in chunks of about a megabyte, compressed, whose number and byte offset are a window's
position. A longer document is one chunk, hashed in pieces that overlap by a window. The first copy is the first
in the order of partitions and rows.

Edge cases: null and empty texts have no bytes; a text shorter than a window has none to remove; repeated
rows are copies; a copy within one document counts; windows that overlap themselves (runs of one byte) too.
In ``remove``, cuts move inward to whole characters, a document left without text is kept as empty. Extra
columns of any name are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.suffixes import common_prefixes, previous_factors, suffix_array
from strandline.llm.hashing import SpanHash, blocks, text_bytes
from strandline.llm.stream import gathered
from strandline.llm.work import Scratch, lean

LENGTH, CHUNK, HOT, SHARD = 200, 1 << 20, 4096, 1 << 18
_POS_BITS = np.uint64(28)


def grams(length: int) -> list[int]:
    """Lengths of the substrings that route windows, from level to level; the last is the window itself."""
    return [max(1, length * i // 4) for i in (1, 2, 3, 4)]


def stretches(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Minimizer, content hash, first window and number of windows of each stretch of the texts."""
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), empty, empty
    spans = SpanHash(data)
    at = np.arange(n - k + 1)
    h = spans(at, at + k)
    low = (np.uint64(1) << _POS_BITS) - np.uint64(1)
    m = (h & ~low) | at.astype(np.uint64)  # ties: the leftmost
    width, have = length - k + 1, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    # m[p] now is the smallest over the window at p
    where = (m & low).astype(np.int64)
    ok = np.zeros(len(where), bool)
    size = np.diff(off)
    start, stop = off[:-1][size >= length], off[1:][size >= length] - length + 1
    edge = np.zeros(len(where) + 1, np.int64)
    edge[start] += 1
    np.add.at(edge, stop, -1)
    ok = np.cumsum(edge)[:-1] > 0
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (where[1:] != where[:-1])
    first = np.flatnonzero(new)
    last = np.flatnonzero(ok & np.append(~ok[1:] | new[1:], True))
    count = last - first + 1
    return h[where[first]], spans(first, last + length), first, count


def pieces(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, bytes, bounds) of parts of about a chunk at most, which share ``length`` - 1 bytes; together they have each window once."""
    if len(data) <= 2 * CHUNK:
        yield 0, data, off
        return
    for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        for i in range(x, max(x + 1, y - length + 1), CHUNK):
            part = data[i : min(y, i + CHUNK + length - 1)]
            yield i, part, np.array([0, len(part)], np.int64)


def matches(texts: list[bytes], order: np.ndarray, length: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to): byte ranges of the texts whose windows have a match, or with ``keep_first`` an earlier one.

    ``order``: each text's place in the corpus. A match is a longest previous factor (or its mirror image) of
    ``length`` bytes.
    """
    size = np.array([len(x) for x in texts], np.int64)
    end = np.cumsum(size + 1) - 1
    seq = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int16) + np.int16(1)
    seq[end] = 0
    ranks: list = []
    sa = suffix_array(seq, ranks)
    prefixes = common_prefixes(seq, sa, ranks, length)
    del ranks, seq
    row = np.repeat(np.arange(len(texts)), size + 1)
    inner = np.arange(len(sa)) - (end - size)[row]
    place = order[row] * np.int64(1 << 20) + inner
    hit = previous_factors(sa, prefixes, place, length) >= length
    if not keep_first:
        hit |= previous_factors(sa, prefixes, -place, length) >= length
    a, b = _runs(hit, row)
    return row[a], inner[a], inner[b] + length


_CHUNK = [("chunk", pa.int64()), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())]
_OCC = pa.schema([("mh", pa.int64()), ("ch", pa.int64()), ("chunk", pa.int64()), ("pos", pa.int64()), ("n", pa.int32())])
_CTX = pa.schema([("mh", pa.int64()), ("chunk", pa.int64()), ("pos", pa.int64()), ("n", pa.int32()), ("c", pa.int64()), ("types", pa.int64()), ("text", pa.binary())])
_CTX_SQL = "mh long, chunk long, pos long, n int, c long, types long, text binary"
_SUB = pa.schema([("mh", pa.int64()), ("ch", pa.int64()), ("c", pa.int64()), ("chunk", pa.int64()), ("pos", pa.int64()), ("n", pa.int32()), ("text", pa.binary())])
_CUT = pa.schema([("chunk", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_CUT_SQL = "chunk long, a long, b long"


def _runs(flag: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags within one group."""
    new = flag.copy()
    new[1:] &= ~flag[:-1] | (group[1:] != group[:-1])
    end = flag & np.append(~flag[1:] | new[1:], True)
    return np.flatnonzero(new), np.flatnonzero(end)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class _Finder:
    def __init__(self, docs: DataFrame, text: str, length: int, keep_first: bool, scratch: Scratch):
        self.length, self.keep_first, self.scratch = length, keep_first, scratch
        self.ks = grams(length)
        rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
        src = docs.select(F.col(text).alias("text"), F.struct(F.struct(*rest or [F.lit(0).alias("none")]).alias("row"), F.col(text).isNull().alias("no_text")).alias("rows"))
        kind = src.schema["rows"].dataType

        @lean
        def chunk(batches):
            from pyspark import TaskContext

            k = TaskContext.get().partitionId() << 32
            for b in blocks(batches, 0, CHUNK):
                data, off = text_bytes(b.column(0))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([np.diff(off)], pa.list_(pa.int64())), pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(1))],
                    names=["chunk", "sizes", "blob", "rows"],
                )
                k += 1

        out = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("blob", T.BinaryType()), T.StructField("rows", T.ArrayType(kind))])
        self.row_type = kind
        self.chunks = scratch.save(src.mapInArrow(chunk, out), "chunks")

    def occurrences(self) -> DataFrame:
        length, k = self.length, self.ks[0]

        @lean
        def run(batches):
            for b in batches:
                for c, sizes, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                    for at, part, bounds in pieces(_unpack(blob, off), off, length):
                        mh, ch, pos, n = stretches(part, bounds, length, k)
                        yield pa.RecordBatch.from_arrays([_ints(mh), _ints(ch), pa.array(np.full(len(pos), c)), pa.array(pos + at), pa.array(n, pa.int32())], schema=_OCC)

        return self.chunks.select("chunk", "sizes", "blob").mapInArrow(run, "mh long, ch long, chunk long, pos long, n int")

    def contexts(self, wanted: DataFrame) -> DataFrame:
        """The text of the stretches in ``wanted(mh, chunk, pos, n, c, types)``."""
        length = self.length
        asked = wanted.groupBy("chunk").agg(F.collect_list(F.struct("mh", "pos", "n", "c", "types")).alias("asked"))

        @lean
        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    off = np.concatenate([[0], np.cumsum(b.column(1)[i].values.to_numpy(), dtype=np.int64)])
                    raw = memoryview(_unpack(b.column(2)[i], off))
                    asked = b.column(3)[i].values
                    for j in range(0, len(asked), 8192):
                        a = asked.slice(j, 8192)
                        pos, n = a.field("pos"), a.field("n")
                        texts = [bytes(raw[p : p + m + length - 1]) for p, m in zip(pos.to_pylist(), n.to_pylist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([a.field("mh"), pa.array(np.full(len(a), b.column(0)[i].as_py())), pos, n, a.field("c"), a.field("types"), pa.array(texts, pa.binary())], schema=_CTX)

        return self.chunks.select("chunk", "sizes", "blob").join(asked, "chunk").mapInArrow(run, _CTX_SQL)

    def compare(self, ctx: DataFrame) -> DataFrame:
        """Byte ranges to remove, from stretches that share a minimizer (step 3)."""
        length, keep_first = self.length, self.keep_first
        ctx = ctx.select("mh", "chunk", "pos", "text").repartition("mh").sortWithinPartitions("mh")

        @lean
        def run(batches):
            for t in gathered(batches, 1, "text", SHARD):
                chunk, pos = t["chunk"].to_numpy(), t["pos"].to_numpy()
                place = np.lexsort((pos, chunk))
                order = np.empty(len(place), np.int64)
                order[place] = np.arange(len(place))
                row, a, b = matches(t["text"].to_pylist(), order, length, keep_first)
                yield pa.RecordBatch.from_arrays([pa.array(chunk[row]), pa.array(pos[row] + a), pa.array(pos[row] + b)], schema=_CUT)

        return ctx.mapInArrow(run, _CUT_SQL)

    def reroute(self, ctx: DataFrame, level: int) -> DataFrame:
        """Stretches of hot minimizers, cut anew by longer substrings (step 4)."""
        length, k = self.length, self.ks[level]

        @lean
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                raw = b.column(4).to_pylist()
                off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
                joined = b"".join(raw)
                mh, ch, at, n = stretches(np.frombuffer(joined, np.uint8), off, length, k)
                row = np.searchsorted(off, at, "right") - 1
                c, chunk, pos = (b.column(i).to_numpy() for i in (3, 0, 1))
                texts = [joined[i : i + m + length - 1] for i, m in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([_ints(mh), _ints(ch), pa.array(c[row]), pa.array(chunk[row]), pa.array(pos[row] + at - off[row]), pa.array(n, pa.int32()), pa.array(texts, pa.binary())], schema=_SUB)

        return ctx.select("chunk", "pos", "n", "c", "text").mapInArrow(run, "mh long, ch long, c long, chunk long, pos long, n int, text binary")

    def _types(self, occ: DataFrame, count) -> tuple[DataFrame, DataFrame]:
        """Types with their number of occurrences and first place; and those whose minimizer has other types."""
        types = occ.groupBy("mh", "ch").agg(count.alias("c"), F.min(F.struct("chunk", "pos", "n")).alias("rep"))
        types = self.scratch.save(types, "types")
        shared = types.groupBy("mh").agg(F.count("*").alias("types")).where("types > 1")
        return types, types.join(shared, "mh").select("mh", "ch", "c", "types", "rep.chunk", "rep.pos", "rep.n")

    def _repeats(self, occ: DataFrame, types: DataFrame) -> DataFrame:
        """Byte ranges of the occurrences of types that occur twice (step 2)."""
        twice = types.where("c > 1").select("mh", "ch", F.col("rep.chunk").alias("rc"), F.col("rep.pos").alias("rp"))
        hit = occ.select("mh", "ch", "chunk", "pos", "n").join(twice, ["mh", "ch"])
        if self.keep_first:
            hit = hit.where("not (chunk = rc and pos = rp)")
        return hit.select("chunk", F.col("pos").alias("a"), (F.col("pos") + F.col("n") + (self.length - 1)).alias("b"))

    def cuts(self) -> DataFrame:
        """(chunk, a, b): byte ranges to remove, as they were found; they overlap."""
        s = self.scratch
        every = s.save(self.occurrences(), "hashes")
        # written first, so that both sides of the join are plain shuffles and Spark can split a hot minimizer
        again = s.save(every.groupBy("mh").agg(F.count("*").alias("k")).where("k > 1").select("mh"), "minimizers")
        s.release()
        occ = s.save(every.join(again.hint("merge"), "mh", "left_semi"), "occurrences")
        s.drop(every)
        s.drop(again)
        s.release()
        types, shared = self._types(occ, F.count("*"))
        out = [s.save(self._repeats(occ, types), "cuts")]
        s.drop(occ)
        ctx = s.save(self.contexts(shared.drop("ch")), "contexts")
        s.drop(types)
        s.release()
        for level in range(1, len(self.ks) + 1):
            out.append(s.save(self.compare(ctx.where(F.col("types") <= HOT)), "cuts"))
            hot = ctx.where(F.col("types") > HOT)
            if level == len(self.ks) or hot.isEmpty():
                break
            sub = self.reroute(hot, level)
            again = s.save(sub.groupBy("mh").agg(F.sum("c").alias("k")).where("k > 1").select("mh"), "minimizers")
            sub = s.save(sub.join(again, "mh", "left_semi"), "rerouted")
            s.drop(again)
            s.drop(ctx)
            types, shared = self._types(sub, F.sum("c"))
            out.append(s.save(self._repeats(sub, types), "cuts"))
            ctx = s.save(sub.drop("c").join(shared.select("mh", "ch", "chunk", "pos", "c", "types"), ["mh", "ch", "chunk", "pos"]).select("mh", "chunk", "pos", "n", "c", "types", "text"), "contexts")
            s.drop(sub)
            s.release()
        s.drop(ctx)
        cut = out[0]
        for o in out[1:]:
            cut = cut.unionByName(o)
        return cut

    def with_cuts(self) -> DataFrame:
        """The chunks with ``cuts``, the byte ranges to remove."""
        found = self.cuts().groupBy("chunk").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
        self.scratch.release()
        return self.chunks.join(found, "chunk", "left")


def _unpack(blob: pa.Scalar, off: np.ndarray) -> np.ndarray:
    size = int(off[-1])
    return np.frombuffer(pa.decompress(blob.as_buffer(), size, codec="zstd"), np.uint8) if size else np.zeros(0, np.uint8)


def _removed(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Bytes, bounds of texts, and the maximal byte ranges of each text that go, of row i (chunk, sizes, blob, rows, cuts)."""
    off = np.concatenate([[0], np.cumsum(b.column(1)[i].values.to_numpy(), dtype=np.int64)])
    data = _unpack(b.column(2)[i], off)
    gone: list[list[tuple[int, int]]] = [[] for _ in range(len(off) - 1)]
    cuts = b.column(4)[i]
    if cuts.is_valid and len(cuts.values):
        x, y = cuts.values.field("a").to_numpy(), cuts.values.field("b").to_numpy()
        o = np.lexsort((y, x))
        x, y = x[o], np.maximum.accumulate(y[o])
        doc = np.searchsorted(off, x, "right") - 1
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] > y[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(x)) - 1
        for d, p, q in zip(doc[first].tolist(), x[first].tolist(), y[last].tolist(), strict=True):
            gone[d].append((p, q))
    return data, off, gone


def _kept(start: int, stop: int, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of [start, stop) without the sorted ranges."""
    edges = [start, *[e for r in gone for e in r], stop]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def removal_digest(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each document."""
    finder = _Finder(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", length, keep_first, Scratch(docs.sparkSession, "suffixes"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    @lean
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data, off, gone = _removed(b, i)
                shas = []
                for x, y, g in zip(off[:-1].tolist(), off[1:].tolist(), gone, strict=True):
                    sha = hashlib.sha256()
                    for p, q in _kept(x, y, g):
                        sha.update(data[p:q])
                    shas.append(sha.hexdigest())
                removed = [sum(q - p for p, q in g) for g in gone]
                ids = b.column(3)[i].values.field("row").field("doc_id")
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(off), pa.int64()), pa.array(removed, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(shas)], schema=schema)

    return finder.with_cuts().select("chunk", "sizes", "blob", "rows", "cuts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; all rows and columns stay."""
    cols = docs.columns
    finder = _Finder(docs, text, length, keep_first, Scratch(docs.sparkSession, "suffixes"))
    out = T.StructType([T.StructField("row", finder.row_type), T.StructField("text", T.StringType())])

    @lean
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data, off, gone = _removed(b, i)
                rows = b.column(3)[i].values
                none = rows.field("no_text").to_pylist()
                texts = []
                for x, y, g, z in zip(off[:-1].tolist(), off[1:].tolist(), gone, none, strict=True):
                    left = _kept(x, y, [_whole(data, p, q, y) for p, q in g])
                    texts.append(None if z else b"".join(data[p:q].tobytes() for p, q in left).decode("utf-8"))
                yield pa.RecordBatch.from_arrays([rows, pa.array(texts, pa.string())], names=["row", "text"])

    got = finder.with_cuts().select("chunk", "sizes", "blob", "rows", "cuts").mapInArrow(run, out)
    return got.select(*[F.col("text").alias(c) if c == text else F.col(f"row.row.`{c}`") for c in cols])


def _whole(data: np.ndarray, p: int, q: int, stop: int) -> tuple[int, int]:
    """[p, q) without the characters that it has only in part."""
    while p < q and data[p] & 0xC0 == 0x80:
        p += 1
    while p < q < stop and data[q] & 0xC0 == 0x80:
        q -= 1
    return p, q
