"""Document quality by Bradley-Terry ranking of preference pairs.

A pair prefers a document labelled 1 to one labelled 0; the model is a linear score, learned by logistic loss
on the difference of the two feature vectors. ``train`` learns from all labelled documents and all their pairs
(``ranking``): features are computed where the texts are and kept in a table, which each step of the fit sweeps
once or twice; sums come to the driver. The score's cut is a quantile of the scores of all documents learned from:
the share of rows labelled 0. The returned score is a logistic of the distance to the cut. ``Ranker.fit`` is for
rows in memory, with ``pairs_per_doc`` pairs for each, their partners drawn by a fixed generator.

Features come from the whole text's bytes: shares of kinds of bytes, lengths of words and lines, repeated
words, word pairs and lines, and the text's length. Language, source, id and labels are no inputs.

Edge cases: null and empty texts get features of zeros and so a score between 0 and 1; without labels of
both kinds every score is 0.5; null labels are not used; repeated rows are scored each, and a labelled id is
learned from once, with the text whose features come first in order, and the largest of its labels. Extra columns are
kept.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.hashing import LOWER, SpanHash, blocks, mix, text_bytes, words
from strandline.llm.linear import fit_dense, sigmoid
from strandline.llm.ranking import Sweep, add, fit_pairs, quantiles
from strandline.llm.work import Scratch, lean, small_batches

PAIRS_PER_DOC, BLOCK = 8, 1 << 20
#: Rows of features in a file, which one task sweeps.
ROWS_A_SWEEP = 1 << 15
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_KINDS = [np.isin(np.arange(256), np.frombuffer(k, np.uint8)) for k in (b"0123456789", b".,;:", b"!?", b"#$%&*", b"|<>{}[]\\/=_~^@+", b"\n", b"()\"'-")]
_UPPER, _ALPHA = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each document."""
    if not len(key):
        return np.zeros(n)
    code = np.unique(mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    return np.bincount(doc[code], minlength=n).astype(float)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    of = np.repeat(np.arange(n), np.diff(off))

    def share(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[off[1:]] - c[off[:-1]]) / np.maximum(size, 1)

    cols = [share(k[data]) for k in _KINDS] + [share(_UPPER[data]), share(_ALPHA[data]), share(_SPACE[data])]
    low = LOWER[data]
    h = SpanHash(low)
    s, e, first = words(data, off, ~_SPACE)
    nw = np.diff(first).astype(float)
    wd = of[s] if len(s) else np.zeros(0, np.int64)
    wh = h(s, e)
    length = (e - s).astype(float)
    mean = np.bincount(wd, length, n) / np.maximum(nw, 1)
    cols += [mean, np.sqrt(np.maximum(0, np.bincount(wd, length**2, n) / np.maximum(nw, 1) - mean**2))]
    cols.append(np.bincount(wd, length == 1, n) / np.maximum(nw, 1))
    same = wd[1:] == wd[:-1]
    pair = (wh[:-1] * np.uint64(3) + wh[1:])[same]
    uniq, uniq2 = _distinct(wh, wd, n), _distinct(pair, wd[1:][same], n)
    cols += [1 - uniq / np.maximum(nw, 1), 1 - uniq2 / np.maximum(nw - 1, 1), uniq / np.sqrt(np.maximum(nw, 1)) / 10]
    cols.append(np.bincount(wd[1:][same], (wh[:-1] == wh[1:])[same], n) / np.maximum(nw, 1))
    tail = data[np.maximum(e - 1, 0)] if len(e) else np.zeros(0, np.uint8)
    cols += [np.bincount(wd, k[tail], n) / np.maximum(nw, 1) for k in (_KINDS[1], _KINDS[2], _KINDS[3] | _KINDS[4])]
    cols.append(np.bincount(wd, _UPPER[data[s]], n) / np.maximum(nw, 1) if len(s) else np.zeros(n))
    nl = np.ones(256, bool)
    nl[10] = False
    ls, le, lf = words(data, off, nl)
    nlines = np.diff(lf).astype(float)
    ld = of[ls] if len(ls) else np.zeros(0, np.int64)
    cols += [1 - _distinct(h(ls, le), ld, n) / np.maximum(nlines, 1), np.log1p(size / np.maximum(nlines, 1))]
    cols += [np.log1p(nw), np.log1p(nw) ** 2 / 10, (nw == 0).astype(float)]
    x = np.stack(cols, 1)
    x[size == 0] = 0
    return x


class Ranker:
    def __init__(self, max_quantile: float = 0.95):
        self.w = None
        self.max_quantile = max_quantile

    def fit(self, x: np.ndarray, y: np.ndarray, pairs_per_doc: int = PAIRS_PER_DOC) -> Ranker:
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return self
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z = self._wide(x)
        rng = np.random.default_rng(7)
        win = np.concatenate([np.repeat(good, pairs_per_doc), rng.choice(good, len(bad) * pairs_per_doc)])
        lose = np.concatenate([rng.choice(bad, len(good) * pairs_per_doc), np.repeat(bad, pairs_per_doc)])
        self.w = fit_dense(z[win] - z[lose], np.ones(len(win)), l2=1e-3, bias=False)
        s = z @ self.w
        q = min(self.max_quantile, len(bad) / len(y))
        lo, hi = np.quantile(s, [max(0, q - 0.005), min(1, q + 0.005)])
        self.cut = float((lo + hi) / 2)
        return self

    def fit_all(self, sweep: Sweep) -> Ranker:
        """On all pairs of the rows that ``sweep`` reaches; in whatever order and blocks they come, but for the last digits, which are rounded off."""
        n, good, sums = sweep(lambda x, y: (len(y), int(y.sum()), x.sum(0))) or (0, 0, 0)
        if not good or good == n:
            return self
        self.mean = np.round(sums / n, 12)
        mean = self.mean
        self.std = np.round(np.sqrt(sweep(lambda x, y: ((x - mean) ** 2).sum(0)) / n), 12) + 1e-6
        self.w = np.round(fit_pairs(sweep, self._wide, 2 * len(mean)), 9)
        q = min(self.max_quantile, (n - good) / n)
        lo, hi = quantiles(sweep, lambda x: self._wide(x) @ self.w, 1 + 6 * float(np.abs(self.w).sum()), n, [max(0, q - 0.005), min(1, q + 0.005)])
        self.cut = float(np.round((lo + hi) / 2, 9))
        return self

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([z, z * z / 6])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), 0.5)
        return sigmoid(self._wide(x) @ self.w - self.cut)


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fitted on all ids of ``labels(doc_id, quality)`` that have a document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max(F.col("quality").cast("long")).alias("y"))

    @lean
    def featured(batches):
        for b in blocks(batches, 1, BLOCK):
            x = features(*text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    # features, a tenth of the texts' size, are dealt out by id, not the texts; one row an id, however often it repeats
    src = docs.where("doc_id is not null").select("doc_id", "text")
    rows = src.mapInArrow(featured, T.StructType([src.schema["doc_id"], T.StructField("x", T.BinaryType())])).groupBy("doc_id").agg(F.min("x").alias("x")).join(marks, "doc_id").select("x", "y")
    table = scratch.save(rows.coalesce(1 + marks.count() // ROWS_A_SWEEP), "features")

    def sweep(f):
        @lean
        def run(batches):
            got = None
            for b in batches:
                if b.num_rows:
                    part = f(np.frombuffer(b"".join(b.column(0).to_pylist())).reshape(b.num_rows, -1), b.column(1).to_numpy())
                    got = part if got is None else add(got, part)
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], names=["part"])

        out = None
        for r in table.mapInArrow(run, "part binary").collect():
            out = pickle.loads(r["part"]) if out is None else add(out, pickle.loads(r["part"]))
        return out

    ranker = Ranker().fit_all(sweep)
    scratch.drop(table)
    return ranker


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if the score is at least 0.5)."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(ranker)
    kept = [c for c in docs.columns if c not in {"score", "predicted"}]
    src = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"))

    @lean
    def run(batches):
        for b in blocks(batches, 0, BLOCK):
            s = model.value.score(features(*text_bytes(b.column(0))))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["__row", "score", "predicted"])

    out = T.StructType([src.schema["__row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return src.mapInArrow(run, out).select("__row.*", "score", "predicted")
