"""Token counts kept as rollups by signed deltas.

A batch brings inserts, deletes and revisions of documents. Each becomes signed rows: an insert adds its
counts, a delete subtracts them, a revision subtracts the old and adds the new. A batch is summed to one
small delta by (source, language, tokenizer version), written to a folder of its own.

What counts is the ledger's log: numbered entries, each created whole or not at all, and never twice. An entry
names a batch and the folder that it adds, or the folders that a fold replaces by one. A writer that finds its
number taken reads the log again, so a batch committed twice, or by two writers at once, counts once. Readers
take the folders that the newest entry leaves live; a crash at any point leaves at most a folder that no
entry names. Every ``SNAPSHOT`` entries one also holds the whole state, so few entries are read.

Edge cases: a null text has no tokens but counts as a document; a null source or language is a key of its
own; an empty batch commits a delta without rows; repeated rows count each; a delete of a row never
inserted gives negative totals, which show the error and vanish with the missing insert. Extra columns are
not read.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import work

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_chars", "n_tokens")
SNAPSHOT = 64


def _counts(docs: DataFrame, tokenizers: dict[str, str | None]) -> DataFrame:
    """Rows (source, lang, sign, n_chars, tokenizer, n_tokens): one for each document and tokenizer.

    ``tokenizers`` maps a version's name to a vocabulary file, or to None for words between white space.
    """
    names = list(tokenizers)
    schema = pa.schema([("source", pa.string()), ("lang", pa.string()), ("sign", pa.int64()), ("n_chars", pa.int64()), *((f"t{i}", pa.int64()) for i in range(len(names)))])

    @work.lean
    def run(batches):
        from strandline.llm.packing import BpeCounter

        counters = [BpeCounter(tokenizers[k]).count if tokenizers[k] else lambda t: len(t.encode("utf-8").split()) for k in names]
        for batch in batches:
            source, lang, sign = (batch.column(i).cast(schema.field(i).type) for i in range(3))
            texts = [x.as_py() or "" for x in batch.column(3)]
            cols = [pa.array([c(t) for t in texts], pa.int64()) for c in counters]
            yield pa.RecordBatch.from_arrays([source, lang, sign, pa.array([len(t) for t in texts], pa.int64()), *cols], schema=schema)

    sql = "source string, lang string, sign long, n_chars long, " + ", ".join(f"t{i} long" for i in range(len(names)))
    wide = docs.select("source", "lang", F.col("sign").cast("long"), "text").mapInArrow(run, sql)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("tokenizer"), F.col(f"t{i}").alias("n_tokens")) for i, k in enumerate(names)]))
    return wide.groupBy("source", "lang").agg(
        F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars"), *[F.sum(F.col("sign") * F.col(f"t{i}")).alias(f"t{i}") for i in range(len(names))]
    ).select("source", "lang", "n_docs", "n_chars", each.alias("e")).select("source", "lang", "e.tokenizer", "n_docs", "n_chars", "e.n_tokens")


def signed(inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: DataFrame | None = None) -> DataFrame:
    """One frame (source, lang, text, sign). ``revised`` has old_source, old_lang, old_text beside the new columns."""
    parts = []
    if inserts is not None:
        parts.append(inserts.select("source", "lang", "text", F.lit(1).alias("sign")))
    if deletes is not None:
        parts.append(deletes.select("source", "lang", "text", F.lit(-1).alias("sign")))
    if revised is not None:
        parts.append(revised.select(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_text").alias("text"), F.lit(-1).alias("sign")))
        parts.append(revised.select("source", "lang", "text", F.lit(1).alias("sign")))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class _State:
    """What the log's entries up to number ``n`` leave: live folders with their batch, and the ids of all committed batches."""

    n: int = 0
    live: dict[str, str | None] = field(default_factory=dict)
    ids: set[str] = field(default_factory=set)

    def apply(self, entry: dict) -> None:
        if "live" in entry:
            self.live, self.ids = dict(entry["live"]), set(entry["ids"])
            return
        for x in entry["drop"]:
            self.live.pop(x, None)
        self.live[entry["add"]] = entry["batch"]
        if entry["batch"] is not None:
            self.ids.add(entry["batch"])


class TokenLedger:
    """Deltas in ``data/`` and the log in ``log/`` of one folder."""

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_chars long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, str | None]):
        self.spark, self.path, self.tokenizers = spark, path.rstrip("/"), tokenizers
        work.small_batches(spark)

    def _state(self) -> _State:
        found = sorted(x[:20] for x in work.names(self.spark, f"{self.path}/log") if len(x) == 25 and x.endswith(".json"))
        state = _State(len(found))
        start = len(found) // SNAPSHOT * SNAPSHOT
        for k in range(max(1, start), len(found) + 1):
            state.apply(json.loads(work.read_text(self.spark, self._entry(k))))
        return state

    def _entry(self, n: int) -> str:
        return f"{self.path}/log/{n:020d}.json"

    def _append(self, state: _State, batch: str | None, add: str, drop: list[str]) -> bool:
        """The next entry after ``state``; False if another writer has been faster."""
        entry: dict = {"batch": batch, "add": add, "drop": drop}
        n = state.n + 1
        if n % SNAPSHOT == 0:
            after = _State(state.n, dict(state.live), set(state.ids))
            after.apply(entry)
            entry |= {"live": after.live, "ids": sorted(after.ids)}
        return work.create(self.spark, self._entry(n), json.dumps(entry))

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Adds the signed rows of a batch once; False if the batch was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError(f"a batch id has letters, digits, _ . - only: {batch_id!r}")
        if batch_id in self._state().ids:
            return False
        name = self._write(_counts(rows, self.tokenizers))
        while True:
            state = self._state()
            if batch_id in state.ids:
                work.delete(self.spark, f"{self.path}/data/{name}")
                return False
            if self._append(state, batch_id, name, []):
                return True

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/data/{x}" for x in folders]).select(*KEYS, *SUMS)

    def deltas(self) -> DataFrame:
        return self._read(list(self._state().live))

    def totals(self) -> DataFrame:
        """Totals by key; keys whose documents are all gone are left out."""
        t = self.deltas().groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return t.where(" or ".join(f"{c} <> 0" for c in SUMS))

    def rollup(self) -> DataFrame:
        """Totals at every level of tokenizer > source > language; ``level`` is 0 for single keys, 1 and 3 for sums."""
        t = self.totals()
        r = t.rollup("tokenizer", "source", "lang").agg(*[F.sum(c).alias(c) for c in SUMS], F.grouping_id().alias("level"))
        return r.where("level < 7").select("tokenizer", "source", "lang", F.col("level").cast("long").alias("level"), *SUMS)

    def compact(self, folded: list[str] | None = None) -> bool:
        """Folds the live deltas, or those of the named batches, into one; their ids stay known. False if another fold came first."""
        old = [x for x, batch in self._state().live.items() if folded is None or batch in folded]
        if len(old) < 2:
            return False
        name = self._write(self._read(old).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]))
        while True:
            state = self._state()
            if not set(old) <= state.live.keys():
                work.delete(self.spark, f"{self.path}/data/{name}")
                return False
            if self._append(state, None, name, old):
                return True

    def clean(self) -> int:
        """Deletes the folders that are not live, once no reader or writer is at work; their number."""
        dead = set(work.names(self.spark, f"{self.path}/data")) - self._state().live.keys()
        for x in dead:
            work.delete(self.spark, f"{self.path}/data/{x}")
        return len(dead)
