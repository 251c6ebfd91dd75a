"""Toxicity by a classifier chain over hashed word features.

The chain predicts categories one after another: each model is a logistic regression whose inputs are the
text's features and the probabilities that earlier models gave. In training, those probabilities are out of
fold, so that a later model sees what it will see on new text. The out-of-fold scores also choose each model's
regularisation and the threshold of the decision, in which every toxic category of the chain takes part. The
models are fitted on the driver on at most ``max_train`` labelled ids (those with the smallest hash), one text
each; scoring reads whole texts on the executors.

Features: which lower-cased words occur, and which first four and five characters of longer words, hashed
into ``2**bits`` slots. A model uses the ``MAX_FEATURES`` slots that speak for its category most (chi-squared)
among those in some texts of it, three or, where few are labelled and held-out scores are clearly better for it, one. Whether a word occurs does not fade with a text's length.

Edge cases: null and empty texts have no features and are not rejected; ids may be null or repeat (each row
is scored on its own; of a labelled id's texts the smallest one is learned from, and of its marks the largest);
without labelled rows of both kinds a category's probability is 0; labels that are
null are not used. Extra columns are kept, those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.hashing import LOWER, SpanHash, blocks, text_bytes, words
from strandline.llm.linear import Rows, fit_sparse, sigmoid
from strandline.llm.work import lean, small_batches

#: Category name -> condition on a labelled row with columns ``quality`` and ``toxic``; the chain's order.
CATEGORIES: dict[str, Callable[[], Column]] = {
    "junk": lambda: F.col("quality") == 0,
    "toxic": lambda: F.col("toxic") == 1,
    "toxic_junk": lambda: (F.col("toxic") == 1) & (F.col("quality") == 0),
}
#: The categories that reject a text.
TARGETS = ("toxic", "toxic_junk")
BITS, MAX_TRAIN, FOLDS, MAX_FEATURES, BLOCK = 20, 12_000, 4, 400, 1 << 20
#: Strengths of regularisation, and numbers of texts that a slot is in at least, to choose from; bounds of the threshold.
STRENGTHS, LEAST_TEXTS, THRESHOLDS = (1e-5, 1e-4, 1e-3), (3, 1), (0.25, 0.75)
#: How much better than a choice before it a later one has to be.
CLEARLY = 0.98
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def features(data: np.ndarray, off: np.ndarray, bits: int, wanted: np.ndarray | None = None) -> Rows:
    """The slots of each text's words and word beginnings, each once; of those marked in ``wanted``, if given."""
    data = LOWER[data]
    s, e, first = words(data, off, _WORD)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    h = SpanHash(data)
    lead = (data & 0xC0) != 0x80  # first bytes of characters
    where = np.flatnonzero(np.append(lead, True))
    at = np.searchsorted(where, s)
    keys, rows = [h(s, e)], [doc]
    for k in (4, 5):
        end = where[np.minimum(at + k, len(where) - 1)]
        ok = end < e
        keys.append(h(s[ok], end[ok]) + np.uint64(k))
        rows.append(doc[ok])
    slot = (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)
    row = np.concatenate(rows)
    if wanted is not None:
        ok = wanted[slot]
        slot, row = slot[ok], row[ok]
    code = np.unique((row << bits) | slot)
    idx, row = code & ((1 << bits) - 1), code >> bits
    return Rows(idx, np.ones(len(idx)), np.searchsorted(row, np.arange(len(off))))


def _chi(a: np.ndarray, n_a: np.ndarray, n1: float, n0: float, least: int = 1) -> np.ndarray:
    """How much each slot speaks for a category: in ``a`` texts of it, of ``n_a`` in all. 0 if it speaks against, or is in fewer than ``least``."""
    b = n_a - a
    chi = (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(1, n_a * (n1 + n0 - n_a))
    chi[(a < least) | (a * n0 <= b * n1)] = 0
    return chi


def _telling(x: Rows, y: np.ndarray, n: int, least: int = 1) -> np.ndarray:
    """The slots that tell y best."""
    chi = _chi(np.bincount(x.idx, y[x.row], n), np.bincount(x.idx, minlength=n).astype(float), float(y.sum()), float(len(y) - y.sum()), least)
    best = np.argsort(-chi, kind="stable")[:MAX_FEATURES]
    return np.sort(best[chi[best] > 0])


def _candidates(parts: list[np.ndarray], y: np.ndarray, n: int) -> list[np.ndarray]:
    """The rows, cut down to four times the slots that any category's model may use.

    Rows are counted a thousand at a time, so the whole sample is never spread out in memory.
    """
    seen, of = np.zeros(n), np.zeros((y.shape[1], n))
    for i in range(0, len(parts), 1000):
        part = parts[i : i + 1000]
        idx = np.concatenate(part).astype(np.int64)
        row = np.repeat(np.arange(i, i + len(part)), [len(p) for p in part])
        seen += np.bincount(idx, minlength=n)
        for c in range(y.shape[1]):
            hit = y[row, c] == 1
            of[c] += np.bincount(idx[hit], minlength=n)
    keep = np.zeros(n, bool)
    for c in range(y.shape[1]):
        chi = _chi(of[c], seen, float(y[:, c].sum()), float(len(y) - y[:, c].sum()))
        best = np.argsort(-chi, kind="stable")[: 4 * MAX_FEATURES]
        keep[best[chi[best] > 0]] = True
    return [p[keep[p]] for p in parts]


def _narrow(x: Rows, slots: np.ndarray) -> Rows:
    """The same rows over the given slots only, numbered from 0."""
    if not len(slots):
        return Rows(np.zeros(0, np.int64), np.zeros(0), np.zeros(len(x.off), np.int64))
    at = np.minimum(np.searchsorted(slots, x.idx), len(slots) - 1)
    ok = slots[at] == x.idx
    return Rows(at[ok], x.val[ok], np.concatenate([[0], np.cumsum(ok)])[x.off])


class Chain:
    """Fitted models, in the chain's order."""

    def __init__(self, names: list[str], bits: int, targets: tuple[str, ...] = TARGETS):
        self.names, self.bits, self.models, self.threshold = names, bits, [], 0.5
        self.targets = [i for i, n in enumerate(names) if n in targets]

    def _one(self, x: Rows, extra: np.ndarray, y: np.ndarray, l2: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots = _telling(x, y, 1 << self.bits, least)
        weight = np.where(y == 1, min(10.0, (len(y) - y.sum()) / y.sum()), 1.0)
        w, v = fit_sparse(_narrow(x, slots), extra, y, len(slots), l2, weight)
        return slots, w, v

    @staticmethod
    def _apply(model, x: Rows, extra: np.ndarray) -> np.ndarray:
        slots, w, v = model
        return sigmoid(_narrow(x, slots).dot(w) + extra @ v[:-1] + v[-1])

    def _held_out(self, x: Rows, extra: np.ndarray, y: np.ndarray, fold: np.ndarray, l2: float, least: int) -> np.ndarray:
        """Probabilities of each row by a model that has not seen its fold."""
        out = np.zeros(len(y))
        for f in np.unique(fold):
            a, b = fold != f, fold == f
            if 0 < y[a].sum() < a.sum():
                out[b] = self._apply(self._one(x.pick(a), extra[a], y[a], l2, least), x.pick(b), extra[b])
            elif a.any():
                out[b] = y[a].mean()
        return out

    def fit(self, x: Rows, y: np.ndarray, fold: np.ndarray, strengths: tuple[float, ...] = STRENGTHS) -> Chain:
        """``y``: a column of 0 and 1 for each category. ``fold``: each row's fold."""
        extra = np.zeros((len(fold), 0))
        for c in range(len(self.names)):
            t = y[:, c].astype(float)
            best = np.zeros(len(t))
            if t.min(initial=1) == t.max(initial=0) or not len(t):
                self.models.append(None)
            else:
                loss, chosen = np.inf, (strengths[0], LEAST_TEXTS[0])
                for least in LEAST_TEXTS:
                    for l2 in strengths:
                        p = self._held_out(x, extra, t, fold, l2, least)
                        q = np.clip(np.where(t == 1, p, 1 - p), 1e-3, 1)
                        if -np.log(q).mean() < loss * (CLEARLY if least != chosen[1] else 1):
                            loss, chosen, best = -np.log(q).mean(), (l2, least), p
                self.models.append(self._one(x, extra, t, *chosen))
            extra = np.hstack([extra, best[:, None]])
        self._decide(extra, y)
        return self

    def _decide(self, held_out: np.ndarray, y: np.ndarray) -> None:
        """The threshold with the best F1 out of fold; of equally good ones, the one nearest to a half."""
        if not self.targets or not len(y):
            return
        s, t = held_out[:, self.targets].max(1), y[:, self.targets].max(1) == 1
        grid = np.round(np.arange(THRESHOLDS[0], THRESHOLDS[1] + 0.005, 0.01), 2)
        f1 = np.array([2 * (t & (s >= g)).sum() / max(1, t.sum() + (s >= g).sum()) for g in grid])
        good = grid[f1 >= f1.max() - 1e-12]
        self.threshold = float(good[np.argmin(np.abs(good - 0.5))])

    def toxicity(self, p: np.ndarray) -> np.ndarray:
        """The largest probability of a category that rejects."""
        return p[:, self.targets].max(1) if self.targets else np.zeros(len(p))

    def wanted(self) -> np.ndarray:
        """Which slots some model uses."""
        used = np.zeros(1 << self.bits, bool)
        for m in self.models:
            if m is not None:
                used[m[0]] = True
        return used

    def predict(self, x: Rows) -> np.ndarray:
        out = np.zeros((len(x.off) - 1, len(self.names)))
        for c, m in enumerate(self.models):
            if m is not None:
                out[:, c] = self._apply(m, x, out[:, :c])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Callable[[], Column]] | None = None, max_train: int = MAX_TRAIN, bits: int = BITS) -> Chain:
    """A chain fitted on at most ``max_train`` labelled documents."""
    small_batches(docs.sparkSession)
    categories = categories or CATEGORIES
    chain = Chain(list(categories), bits)
    marks = labels.where("doc_id is not null").select("doc_id", *[F.coalesce(c().cast("int"), F.lit(0)).alias(f"y{i}") for i, c in enumerate(categories.values())])
    names = [f"y{i}" for i in range(len(categories))]
    # the sample's size is a parameter, so it may be broadcast; one text an id, however often it repeats
    sample = marks.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    found = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = found.join(F.broadcast(sample), "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.list_(pa.int64())), ("idx", pa.binary())])

    @lean
    def run(batches):
        for b in blocks(batches, 0, BLOCK):
            rows = features(*text_bytes(b.column(0)), bits)
            parts = [rows.idx[i:j].astype("<u4").tobytes() for i, j in zip(rows.off[:-1], rows.off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int64()), b.column(2).cast(pa.list_(pa.int64())), pa.array(parts, pa.binary())], schema=schema)

    got = found.select("text", F.col("doc_id").cast("long"), F.array(*[F.col(n).cast("long") for n in names]).alias("y")).mapInArrow(run, "doc_id long, y array<long>, idx binary").toArrow()
    if not got.num_rows:
        return chain.fit(Rows(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64)), np.zeros((0, len(names))), np.zeros(0))
    # the rows come in any order; the model must not depend on it
    ids, raw = got["doc_id"].to_pylist(), got["idx"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
    y = np.asarray(got["y"].to_pylist())[order]
    parts = _candidates([np.frombuffer(raw[i], "<u4") for i in order], y, 1 << bits)
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    flat = np.concatenate(parts).astype(np.int64)
    return chain.fit(Rows(flat, np.ones(len(flat)), off), y, np.asarray([ids[i] for i in order]) % FOLDS)


def score(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and ``rejected`` (a toxic one reaches the threshold, by default the chain's)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]
    kept = [c for c in docs.columns if c not in {*names, "rejected"}]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"))
    text, cut = kept.index("text"), chain.threshold if threshold is None else threshold

    @lean
    def run(batches):
        m = model.value
        wanted = m.wanted()
        # the text travels once, within its row
        pairs = (pa.RecordBatch.from_arrays([b.column(0).field(text), b.column(0)], names=["text", "__row"]) for b in batches)
        for b in blocks(pairs, 0, BLOCK):
            x = features(*text_bytes(b.column(0)), m.bits, wanted)
            p = m.predict(x)
            rejected = (m.toxicity(p) >= cut) & (np.diff(x.off) > 0)
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array(p[:, i]) for i in range(p.shape[1])], pa.array(rejected)], names=["__row", *names, "rejected"])

    out = T.StructType([src.schema["__row"], *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("rejected", T.BooleanType())])
    return src.mapInArrow(run, out).select("__row.*", *names, "rejected")
