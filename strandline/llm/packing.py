"""Packing tokenised documents into training windows with bounded space.

Each partition reads its documents once and keeps a fixed number of open windows. A piece goes to the
open window that it leaves fullest (best fit). When it fits none, the fullest window is topped up with a
cut of the piece if its gap is worth a cut, and emitted. The windows still open at a partition's end are
few, whatever the partition's size; a second pass merges them, in groups by hash.

Edge cases: a null text is empty and has just the end token; repeated rows are packed each on its own; a
document longer than a window fills whole windows first; an empty table gives no rows. Columns other than
the id and the text are not read, so extra ones cannot clash.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.work import Scratch, lean

# Fixed value: how this kind of vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class no two versions of Unicode tables disagree on.
_SETTLED = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u2030-\u203a\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*\\Z")


def _byte_of() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable ones themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class BpeCounter:
    """Ids of texts as the public ``tokenizers`` library gives them for a byte-level BPE file.

    The same vocabulary and merge order run in ``tiktoken``, which is several times faster. Texts with characters
    whose class depends on the library's Unicode tables go to ``tokenizers`` itself, as does everything if the
    file's merges are not in the order of their ids; the first ``CHECKED`` texts go to both, and a difference is
    an error.
    """

    CHECKED = 8

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.fast = self._fast(path)
        self.left = self.CHECKED

    @staticmethod
    def _fast(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        byte = _byte_of()
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return None
        ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or not _SETTLED.match(text):
            return self.tok.encode(text, add_special_tokens=False).ids
        out = self.fast.encode(text, allowed_special="all")
        if self.left:
            self.left -= 1
            if out != self.tok.encode(text, add_special_tokens=False).ids:
                raise RuntimeError("the two tokenizer libraries differ on a text")
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        return np.asarray(self.ids(text), "<u4").tobytes()

    def count(self, text: str) -> int:
        return len(self.ids(text))


class _Windows:
    """Open windows of one partition: (free, number) sorted, and the pieces of each."""

    def __init__(self, size: int, keep: int, first: int):
        self.size, self.keep, self.next = size, keep, first
        self.free: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}

    def place(self, piece, at: int) -> None:
        free, k = self.free.pop(at)
        self.pieces[k].append(piece)
        bisect.insort(self.free, (free - piece[2], k))

    def open(self, piece) -> None:
        self.pieces[self.next] = [piece]
        bisect.insort(self.free, (self.size - piece[2], self.next))
        self.next += 1

    def add(self, piece, min_cut: int) -> Iterator[list]:
        """Places a piece (doc, start, length, ids, doc_tokens); yields windows that are done."""
        while True:
            at = bisect.bisect_left(self.free, (piece[2], -1))
            if at < len(self.free):
                full = self.free[at][0] == piece[2]
                k = self.free[at][1]
                self.place(piece, at)
                if full:
                    self.free.remove((0, k))
                    yield k, self.pieces.pop(k)
                return
            if len(self.free) < self.keep:
                self.open(piece)
                return
            gap, k = self.free[0]
            if gap and gap >= min_cut and piece[2] - gap >= min_cut:
                doc, start, n, ids, total = piece
                self.pieces[k].append((doc, start, gap, ids[: 4 * gap], total))
                piece = (doc, start + gap, n - gap, ids[4 * gap :], total)
            del self.free[0]
            yield k, self.pieces.pop(k)


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_())])
_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"


def _rows(done, keep_ids: bool, still_open: bool):
    for k, pieces in done:
        at = 0
        for doc, start, n, ids, total in pieces:
            yield doc, start, n, zlib.crc32(ids), total, k, at, ids if keep_ids or still_open else None, still_open
            at += n


def _batches(rows, size: int = 4000) -> Iterator[pa.RecordBatch]:
    buf = []
    for r in rows:
        buf.append(r)
        if len(buf) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buf, strict=True), _OUT, strict=True)], schema=_OUT)
            buf = []
    if buf:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buf, strict=True), _OUT, strict=True)], schema=_OUT)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, size: int = 1024, open_windows: int = 64, min_cut: int = 16, end_id: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of the packed windows: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    ``ids`` (little-endian unsigned 32-bit) is null unless ``keep_ids``. A window's pieces are those with
    its ``sequence_id``, in the order of ``offset``. No token is dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    end = np.asarray([end_id], "<u4").tobytes()

    @lean
    def first(batches):
        from pyspark import TaskContext

        bpe = BpeCounter(tokenizer_path)
        w = _Windows(size, open_windows, TaskContext.get().partitionId() << 32)

        def done():
            for batch in batches:
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = bpe.encode(t.as_py() or "") + end
                    total = len(ids) // 4
                    start = 0
                    while total - start >= size:
                        w.next += 1
                        yield w.next - 1, [(doc, start, size, ids[4 * start : 4 * (start + size)], total)]
                        start += size
                    if start < total:
                        yield from w.add((doc, start, total - start, ids[4 * start :], total), min_cut)

        yield from _batches(_rows(done(), keep_ids, False))
        yield from _batches(_rows(sorted(w.pieces.items()), keep_ids, True))

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    one = scratch.save(src.mapInArrow(first, _SQL), "pieces")
    left = one.where("open")
    n_left = left.agg(F.countDistinct("sequence_id")).first()[0]
    groups = max(1, n_left // 4000)

    @lean
    def merge(batches):
        from pyspark import TaskContext

        w = _Windows(size, open_windows, (1 << 62) + (TaskContext.get().partitionId() << 32))

        def done():
            for batch in batches:
                for ids, total, doc, start in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    yield from w.add((doc, start, len(ids) // 4, ids, total), min_cut)
            yield from sorted(w.pieces.items())

        yield from _batches(_rows(done(), keep_ids, False))

    # long pieces first within a group: best fit then leaves the least room
    regrouped = left.select("ids", "doc_tokens", "doc_id", "start", "length", "sequence_id").repartition(groups, F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    merged = regrouped.sortWithinPartitions(F.desc("length"), "sequence_id", "start").select("ids", "doc_tokens", "doc_id", "start").mapInArrow(merge, _SQL)
    return one.where("not open").unionByName(merged).drop("open")
