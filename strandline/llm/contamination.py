"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of a partition, as a sequence of word numbers over the benchmark's vocabulary;
each word outside it, and each end of a document, is a separator of its own. The shard's suffixes are sorted,
the Burrows-Wheeler transform goes into a wavelet matrix, and all test phrases are searched backward at once
by its ranks. The rows of a phrase's range are located by walking to the nearest sampled suffix position.
The occurrences' word spans are merged into spans to remove.

The benchmark is split in blocks of ``block_bytes`` by hash of the item; each block is broadcast as a matrix of
word numbers and handled by a pass of its own over the rows, which carry the spans found so far, so no block
outgrows its bound and documents are not shuffled. After ``CHAINED`` passes the rows are written, so that a task
never has more Python workers.

Edge cases: null or empty texts have no words and no spans; an item without words, or a null one, tests
nothing; an item shorter than a window is one window; item ids that repeat count once; a null item id is the
string ``null``; an empty benchmark finds nothing; repeated documents are each reported. A document of more
than two shards is searched in pieces that share all but one word of a window. Extra columns are kept; those named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.suffixes import suffix_array
from strandline.llm.hashing import LOWER, SpanHash, blocks, text_bytes, words
from strandline.llm.work import Scratch, lean, small_batches

WINDOW, SHARD_BYTES, SAMPLE, BLOCK_BYTES, CHAINED = 13, 4 << 20, 16, 4 << 20, 4
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Phrases:
    """Distinct windows of a block of items: word numbers over the block's vocabulary, and their items."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        data, off = text_bytes(texts)
        data = LOWER[data]
        s, e, first = words(data, off, _WORD)
        self.vocab, code = np.unique(SpanHash(data)(s, e), return_inverse=True)
        n = np.diff(first)
        count = np.where(n == 0, 0, np.maximum(0, n - window) + 1)
        item = np.repeat(np.arange(len(n)), count)
        at = first[:-1][item] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(n[item], window)
        codes = np.zeros((len(at), window), np.int32)  # 0 is the separator
        padded = np.append(code, 0)
        for k in range(window):
            codes[:, k] = np.where(k < length, padded[np.minimum(at + k, len(code))] + 1, 0)
        order = np.lexsort(codes.T[::-1])
        codes, item = codes[order], item[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]).any(1)
        self.codes = codes[new]
        self.length = (self.codes > 0).sum(1)
        # each window's distinct item names, one window after the other
        self.names, named = np.unique(np.array(ids, object).astype(str) if ids else np.zeros(0, str), return_inverse=True)
        pair = np.unique((np.cumsum(new) - 1).astype(np.int64) * max(1, len(self.names)) + (named[item] if len(item) else 0))
        self.item = (pair % max(1, len(self.names))).astype(np.int32)
        self.bounds = np.searchsorted(pair // max(1, len(self.names)), np.arange(len(self.codes) + 1))

    def items(self, which: np.ndarray) -> list[str]:
        """Names of the items that have one of the windows."""
        at = np.concatenate([np.arange(self.bounds[w], self.bounds[w + 1]) for w in which]) if len(which) else np.zeros(0, np.int64)
        return [str(x) for x in self.names[np.unique(self.item[at])]]


class FmIndex:
    """Backward search and location over a sequence of numbers, by a wavelet matrix and sampled suffix positions.

    The sequence ends with a separator (0); one is added if it doesn't.
    """

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        if not len(seq) or seq[-1] != 0:
            seq = np.append(seq, 0)
        n = len(seq)
        sa = suffix_array(seq)
        before = seq[sa - 1]
        before[sa == 0] = 0
        self.n = n
        self.count = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        v = before
        for b in range(self.levels - 1, -1, -1):
            bit = ((v >> b) & 1).astype(bool)
            r = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=r[1:])
            self.ones.append(r)
            self.zeros.append(n - int(r[-1]))
            v = np.concatenate([v[~bit], v[bit]])
        # sampled: every sample-th position and those after a separator, where a walk backward would have to stop
        mark = (sa % sample == 0) | (before == 0)
        self.marked = np.zeros(n + 1, np.int32)
        np.cumsum(mark, out=self.marked[1:])
        self.sampled = sa[mark]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before row i of the transform."""
        lo, i = np.zeros_like(i), i.copy()
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (c >> (self.levels - 1 - k)) & 1
            a, b = ones[lo], ones[i]
            lo = np.where(bit, zeros + a, lo - a)
            i = np.where(bit, zeros + b, i - b)
        return i - lo

    def symbol(self, i: np.ndarray) -> np.ndarray:
        """The transform's symbols at rows i."""
        c, i = np.zeros_like(i), i.copy()
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a = ones[i]
            bit = ones[i + 1] - a
            c = 2 * c + bit
            i = np.where(bit, zeros + a, i - a)
        return c

    def search(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows that start with each phrase (a row of ``codes``, of the given length)."""
        sp, ep = np.zeros(len(codes), np.int64), np.full(len(codes), self.n, np.int64)
        for k in range(codes.shape[1]):
            live = np.flatnonzero((length > k) & (sp < ep))
            if not len(live):
                break
            c = codes[live, length[live] - 1 - k]
            sp[live] = self.count[c] + self.rank(c, sp[live])
            ep[live] = self.count[c] + self.rank(c, ep[live])
        return sp, ep

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at rows, by walking back to sampled ones."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            done = self.marked[at + 1] > self.marked[at]
            out[todo[done]] = self.sampled[self.marked[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            c = self.symbol(at)
            at = self.count[c] + self.rank(c, at)
            steps += 1
        return out


def _search_shard(data: np.ndarray, off: np.ndarray, p: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int, int, int]]], list[set[str]]]:
    """Word counts, merged spans (word from, word to, byte from, byte to) and occurring items of each text."""
    low = LOWER[data]
    s, e, first = words(low, off, _WORD)
    n_docs = len(off) - 1
    spans: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n_docs)]
    items: list[set[str]] = [set() for _ in range(n_docs)]
    n_words = np.diff(first)
    if not len(s) or not len(p.codes):
        return n_words, spans, items
    h = SpanHash(low)(s, e)
    at = np.minimum(np.searchsorted(p.vocab, h), len(p.vocab) - 1)
    code = np.where(p.vocab[at] == h, at + 1, 0)
    # a separator after each document: word k of document d stands at k + d
    doc = np.repeat(np.arange(n_docs), n_words)
    seq = np.zeros(len(s) + n_docs, np.int64)
    seq[np.arange(len(s)) + doc] = code
    fm = FmIndex(seq, len(p.vocab) + 1)
    sp, ep = fm.search(p.codes, p.length)
    n = np.maximum(0, ep - sp)
    if not n.sum():
        return n_words, spans, items
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(sp, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = fm.locate(rows)
    starts = first[:-1] + np.arange(n_docs)
    d = np.searchsorted(starts, pos, "right") - 1
    word = pos - d
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + p.length[which], -1)
    hit = np.append(np.cumsum(cover)[:-1] > 0, False)
    # spans do not join across documents
    begin = np.flatnonzero(hit[:-1] & ~(np.append(False, hit[:-1])[:-1] & (np.arange(len(s)) != first[doc])))
    stop = np.flatnonzero(hit[:-1] & ~(hit[1:] & (np.arange(len(s)) + 1 != first[doc + 1]))) + 1
    for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
        k = int(doc[a])
        spans[k].append((a - int(first[k]), b - int(first[k]), int(s[a] - off[k]), int(e[b - 1] - off[k])))
    pair = np.unique(d * np.int64(len(p.codes)) + which)
    at = np.searchsorted(pair // len(p.codes), np.arange(n_docs + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        items[k].update(p.items(pair[at[k] : at[k + 1]] % len(p.codes)))
    return n_words, spans, items


def _search(data: np.ndarray, off: np.ndarray, p: Phrases, shard_bytes: int) -> tuple[np.ndarray, list, list[set[str]]]:
    """As ``_search_shard``; one document of more than two shards is searched in pieces."""
    if len(off) != 2 or len(data) <= 2 * shard_bytes:
        return _search_shard(data, off, p)
    spans: list = []
    items: set[str] = set()
    at = before = 0
    limit = shard_bytes
    while True:
        stop = min(len(data), at + limit)
        while stop < len(data) and _WORD[LOWER[data[stop]]]:  # not within a word
            stop += 1
        part = data[at:stop]
        n, found, named = _search_shard(part, np.array([0, len(part)], np.int64), p)
        spans = merge_spans(spans, [(a + before, b + before, c + at, d + at) for a, b, c, d in found[0]])
        items |= named[0]
        if stop == len(data):
            return np.array([before + int(n[0])], np.int64), [spans], [items]
        starts = words(LOWER[part], np.array([0, len(part)], np.int64), _WORD)[0]
        on = len(starts) - (p.codes.shape[1] - 1)
        if on <= 0:  # fewer words than a window: a longer piece
            limit *= 2
            continue
        before, at, limit = before + on, at + int(starts[on]), shard_bytes


SPAN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("word_from", "word_to", "byte_from", "byte_to")]))
_SPAN_PA = pa.list_(pa.struct([(n, pa.int64()) for n in ("word_from", "word_to", "byte_from", "byte_to")]))


def merge_spans(old: list, new: list) -> list[tuple]:
    """The union of two sorted lists of spans, touching ones joined only where they overlap or meet in words."""
    out: list[tuple] = []
    for a in sorted([*old, *new]):
        if out and a[0] <= out[-1][1]:
            b = out[-1]
            out[-1] = (b[0], max(b[1], a[1]), b[2], max(b[3], a[3]))
        else:
            out.append(tuple(a))
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (of words and of UTF-8 bytes, merged) and ``items`` (sorted ids that occur)."""
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    names = ("n_words", "spans", "items")
    kept = [c for c in docs.columns if c not in names]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col(text).alias("__text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(SPAN).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for k in range(n_blocks):
        part = bench.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == k).orderBy("id", "text").toArrow()
        phrases = spark.sparkContext.broadcast(Phrases(part["id"].to_pylist(), part["text"].combine_chunks() if part.num_rows else pa.array([], pa.string()), window))

        @lean
        def run(batches, phrases=phrases):
            p = phrases.value
            for b in blocks(batches, 1, shard_bytes):
                n_words, spans, items = _search(*text_bytes(b.column(1)), p, shard_bytes)
                old_spans, old_items = b.column(3), b.column(4)
                if old_spans.null_count < len(old_spans):
                    spans = [merge_spans([tuple(x.values()) for x in o or []], s) for o, s in zip(old_spans.to_pylist(), spans, strict=True)]
                    items = [{*(o or []), *s} for o, s in zip(old_items.to_pylist(), items, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array([[dict(zip(("word_from", "word_to", "byte_from", "byte_to"), x, strict=True)) for x in s] for s in spans], _SPAN_PA), pa.array([sorted(s) for s in items], pa.list_(pa.string()))],
                    names=["__row", "__text", *names],
                )

        out = out.mapInArrow(run, out.schema)
        if k % CHAINED == CHAINED - 1 and k + 1 < n_blocks:
            out = Scratch(spark, "contamination").save(out, "spans")
    return out.select("__row.*", *names)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the text of test phrases: each span is cut out and a line break left in its place.

    A document of which no word is left goes; one without a hit stays as it is, null and empty texts too. Extra
    columns of any name are kept.
    """
    cols = docs.columns
    rest = [F.col(f"`{c}`") for c in cols if c != "text"]
    found = find(docs.select(F.struct(*rest or [F.lit(0).alias("none")]).alias("row"), "text"), benchmark, **options)
    row = found.select("row", "text", "n_words", "spans")
    out = T.StructType([row.schema["row"], T.StructField("text", T.StringType())])

    @lean
    def run(batches):
        for b in batches:
            texts, keep = b.column(1).to_pylist(), np.ones(b.num_rows, bool)
            for i, (s, n) in enumerate(zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if s:
                    raw, at, parts = texts[i].encode("utf-8"), 0, []
                    for x in s:
                        parts.append(raw[at : x["byte_from"]])
                        at = x["byte_to"]
                    parts.append(raw[at:])
                    texts[i] = b"\n".join(parts).decode("utf-8")
                    keep[i] = sum(x["word_to"] - x["word_from"] for x in s) < n
            m = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m), pa.array(texts, pa.string()).filter(m)], names=["row", "text"])

    return row.mapInArrow(run, out).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in cols])
