"""Main text of web pages: nearest-URL page differencing over the blocks that structure does not rule out.

Pages are sorted by host and URL path. Each is parsed to its text blocks, without those that the markup names
as something else (menus, headers, footers, sidebars, forms, adverts, notices, comments, scripts, styles), and
aligned with its nearest pages of the same host that are no copies of it, by a longest common subsequence of
blocks. The shared blocks are the template and go:

- A page that marks its article (``<article>``, ``<main>`` or ``role=main`` elements that the parser opens outside of
  dropped parts and that hold at least half of the text outside of them) keeps the blocks in it but for those
  that every one of ``WITNESSES`` pages on each side shares, two pages at least: neighbours' articles
  have sentences in common, so one page that shares a block does not show that it is template.
- On other pages the blocks go that most of the witnesses on one side share, before or after. A single witness
  on a side counts only if the other side has no more.

Pages that share more than ``copy_share`` of their blocks are copies, or have a long template and short articles. A
third page tells: what is left of copies after the blocks shared with it is alike, too. The third page is the nearest
of ``NEAR`` on each side that shares some blocks but not most; failing that, one of the next that leaves at least
``own_share`` of the blocks. Where no page can tell, they count as copies, and nothing is removed for that pair.
Neighbours that are copies form runs, of any length; the witnesses on a side are of its nearest ``RUNS`` runs.

So a page's text depends on the runs and pages next to it, and on nothing else: not on how many pages the host has, nor on
how they are dealt out. Sorting is by range over all pages, so a host with many pages spreads over many tasks. A task
settles a page when all that it looks at has come, and lets go of pages that no later one can look at (a run of
copies is held whole). Pages that look beyond the edge of a task's range go, with all pages that they can depend on, to a
second step by edge.

Edge cases: null or empty html gives an empty text; a null URL has no neighbours; markup that is cut off or
never closed ends with its parent; character references are decoded once, unknown ones stay; repeated rows
are copies of each other. Extra columns are not read.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.hashing import blocks
from strandline.llm.url_filter import canonical_host, canonical_path
from strandline.llm.work import Scratch, lean

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "noframes", "math")}
_INLINE = frozenset("a abbr acronym b button select textarea input label script style noscript template svg math iframe object audio video canvas map bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br input meta link base param track embed col area".split())
_VOID = frozenset("br input meta link base param track embed col area img source wbr hr".split())
_DROP = frozenset("nav footer aside form head button select dialog menu object video audio canvas map fieldset".split())
_CUES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri(?:be|ption)|sidebar|rail|menu|nav(?:bar|igation)?|breadcrumbs?|footer|footnav|masthead|topbar|toolbar|comments?|replies|respond|disqus|discussion|share|sharing|social|related|recommend(?:ed|ations)?|widget|pagination|pager|login|signup|search(?:form|box)?|skip(?:link)?|print(?:only)?|copyright|legal|hidden)(?=$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: Pages asked on each side, of so many runs of copies at most; pages on each side among which a third one is looked for.
WITNESSES, RUNS, NEAR = 4, 8, 32
#: Bytes of text held before a task looks which pages it can settle; no text depends on it.
HELD = 8 << 20
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attrs(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(text)} if text else {}


def _other(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    """Is an element something else than article text?"""
    if tag in _DROP or (tag == "header" and not in_main):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    role = attrs.get("role", "").lower()
    if role in _ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        return True
    return any(_CUES.search(attrs[k]) for k in ("class", "id") if k in attrs)


def lines(page: str) -> tuple[list[str], bool]:
    """The text blocks of a page that its structure does not rule out, and whether it marks its article.

    Of a page that does, only those inside an article or main element.
    """
    out: list[tuple[str, bool]] = []
    buf: list[str] = []
    stack: list[tuple[str, int]] = []  # tag, and 1 for a part that goes, 2 for main
    gone = main = 0

    def flush():
        text = " ".join(htmllib.unescape("".join(buf)).split())
        if text:
            out.append((text, main > 0))
        buf.clear()

    def pop(n):
        nonlocal gone, main
        while len(stack) > n:
            kind = stack.pop()[1]
            gone -= kind == 1
            main -= kind == 2

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not gone:
            buf.append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            buf.append(" ")
            continue
        if tag not in _INLINE and not gone:
            flush()
        if m.group(1):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(kind == 2 for _, kind in stack[i:]):
                        flush()
                    pop(i)
                    break
            continue
        if tag in _RAW:
            close = _RAW[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in _VOID or m.group(3).endswith("/"):
            continue
        if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == tag:
            pop(len(stack) - 1)
        attrs = _attrs(m.group(3))
        if not gone and _other(tag, attrs, main > 0):
            stack.append((tag, 1))
            gone += 1
        elif not gone and (tag in ("article", "main") or attrs.get("role", "").lower() == "main"):
            flush()
            stack.append((tag, 2))
            main += 1
        else:
            stack.append((tag, 0))
    flush()
    inside = [t for t, in_main in out if in_main]
    if inside and 2 * sum(map(len, inside)) >= sum(len(t) for t, _ in out):
        return inside, True
    return [t for t, _ in out], False


def shared(a: list[str], b: list[str]) -> np.ndarray:
    """Which lines of ``a`` are on a longest common subsequence with ``b``.

    Common ends are matched first; the rest by dynamic programming over rows of booleans in numpy, split in
    halves (Hirschberg), so memory stays linear in the number of lines.
    """
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(t, len(ids)) for t in a], np.int64)
    y = np.array([ids.setdefault(t, len(ids)) for t in b], np.int64)
    hit = np.zeros(len(x), bool)

    def row(p, q):
        """Lengths of the longest common subsequence of p with each prefix of q."""
        prev = np.zeros(len(q) + 1, np.int64)
        for c in p:
            cand = np.where(q == c, prev[:-1] + 1, 0)
            prev = np.maximum(prev, np.concatenate([[0], np.maximum.accumulate(cand)]))
        return prev

    def solve(i, j, k, m):
        while i < j and k < m and x[i] == y[k]:
            hit[i] = True
            i, k = i + 1, k + 1
        while i < j and k < m and x[j - 1] == y[m - 1]:
            hit[j - 1] = True
            j, m = j - 1, m - 1
        if i >= j or k >= m:
            return
        if j - i == 1:
            hit[i] = bool((y[k:m] == x[i]).any())
            return
        mid = (i + j) // 2
        left = row(x[i:mid], y[k:m])
        right = row(x[mid:j][::-1], y[k:m][::-1])[::-1]
        cut = k + int(np.argmax(left + right))
        solve(i, mid, k, cut)
        solve(mid, j, cut, m)

    solve(0, len(x), 0, len(y))
    return hit


_STEP = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.string())), ("marked", pa.bool_()), ("kind", pa.int32()), ("text", pa.string()), ("edge", pa.int32()), ("joins", pa.bool_())])
_STEP_SQL = "page_id long, url string, host string, path string, lines array<string>, marked boolean, kind int, text string, edge int, joins boolean"
_SEP = "\n"


_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("packed", pa.binary()), ("marked", pa.bool_())])
_PARSED_SQL = "page_id long, url string, host string, path string, size long, packed binary, marked boolean"


@lean
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of batches (page_id, url, host, path, html), compressed for the way to their neighbours."""
    for b in blocks(batches, 4, 4 << 20):
        found = [lines(page.as_py()) for page in b.column(4)]
        raw = [_SEP.join(x).encode("utf-8") if x else None for x, _ in found]
        packed = [pa.compress(r, codec="zstd", asbytes=True) if r else None for r in raw]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(b.column(i).cast(pa.string()) for i in (1, 2, 3)), pa.array([len(r) if r else 0 for r in raw], pa.int64()), pa.array(packed, pa.binary()), pa.array([m for _, m in found], pa.bool_())], schema=_PARSED
        )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (page_id, url, host, path, lines, marked, kind)."""
    for b in batches:
        for *row, size, packed, marked in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            yield (*row, pa.decompress(packed, size, codec="zstd", asbytes=True).decode("utf-8").split(_SEP) if size else [], marked, _OPEN)


#: What a look beyond an open end leaves open: the pages before, or after.
_BEFORE, _AFTER = 1, 2


class _Host:
    """Some pages of one host in order: (page_id, url, host, path, lines, marked, kind), without gaps.

    Beyond an open end there may be more pages; ``seen`` gets ``_BEFORE`` or ``_AFTER`` as soon as one of them is asked for.
    """

    def __init__(self, pages: list[tuple], before: bool, after: bool, copy_share: float, own_share: float):
        self.share, self.own_share = copy_share, own_share
        self.before, self.after, self.seen = before, after, 0
        self.nodes: list[list[str]] = []
        self.node_of: list[int] = []
        self.marked: list[bool] = []
        for p in pages:
            if not self.nodes or self.nodes[-1] != p[4] or self.marked[-1] != p[5]:
                self.nodes.append(p[4])
                self.marked.append(p[5])
            self.node_of.append(len(self.nodes) - 1)
        self.sets = [set(x) for x in self.nodes]
        self.thirds: dict[int, tuple[int | None, int]] = {}
        # runs of copies, what their ends leave open, and the ends at most, whatever pages are beyond
        n = len(self.nodes)
        found = [self.watched(self.linked, i) for i in range(n - 1)]
        self.first, self.last, self.least, self.most_ = ([*range(n)] for _ in range(4))
        self.open_first, self.open_last = [_BEFORE * before] * n, [_AFTER * after] * n
        for i, (link, seen) in enumerate(found):
            self.first[i + 1], self.open_first[i + 1] = (self.first[i], self.open_first[i] | seen) if link else (i + 1, seen)
            if link or seen:
                self.least[i + 1] = self.least[i]
        for i, (link, seen) in reversed([*enumerate(found)]):
            self.last[i], self.open_last[i] = (self.last[i + 1], self.open_last[i + 1] | seen) if link else (i, seen)
            if link or seen:
                self.most_[i] = self.most_[i + 1]

    def watched(self, f, *args) -> tuple:
        """What ``f`` gives, and what it leaves open."""
        was, self.seen = self.seen, 0
        out, seen = f(*args), self.seen
        self.seen |= was
        return out, seen

    def has(self, j: int) -> bool:
        if j < 0:
            self.seen |= _BEFORE * self.before
        elif j >= len(self.nodes):
            self.seen |= _AFTER * self.after
        return 0 <= j < len(self.nodes)

    @staticmethod
    def hits(a: list[str], b: list[str]) -> np.ndarray:
        both = set(a) & set(b)
        out = np.zeros(len(a), bool)
        if both:
            out[[i for i, t in enumerate(a) if t in both]] = shared([t for t in a if t in both], [t for t in b if t in both])
        return out

    def most(self, i: int, j: int) -> bool:
        a, b = self.nodes[i], self.nodes[j]
        least, n = self.share * max(len(a), len(b)), min(len(a), len(b))
        if n <= least:
            return False
        # common ends are on every longest common subsequence; mostly they tell
        k = next((k for k in range(n) if a[k] != b[k]), n)
        k += next((m for m in range(n - k) if a[-1 - m] != b[-1 - m]), n - k)
        if k > least:
            return True
        return sum(t in self.sets[j] for t in a) > least and bool(self.hits(a, b).sum() > least)

    def third(self, i: int) -> int | None:
        """The nearest of ``NEAR`` pages on each side that shares lines with page i, but not most."""
        if i not in self.thirds:
            self.thirds[i] = self.watched(self.find_third, i)
        j, seen = self.thirds[i]
        self.seen |= seen
        return j

    def find_third(self, i: int) -> int | None:
        for j in (j for d in range(1, NEAR + 1) for j in (i - d, i + d)):
            if self.has(j) and not self.sets[i].isdisjoint(self.sets[j]) and not self.most(i, j):
                return j
        return None

    def linked(self, i: int) -> bool:
        return self.most(i, i + 1) and self.copies(i, i + 1)

    def copies(self, i: int, j: int) -> bool:
        """Are two pages that share most lines copies of each other?"""
        a, b = self.nodes[i], self.nodes[j]
        if a == b:
            return True

        def left(w):
            return tuple([t for t, h in zip(x, self.hits(x, self.nodes[w]), strict=True) if not h] for x in (a, b))

        w = self.third(i)
        if w is not None and w != j and not self.most(j, w):
            x, y = left(w)
            return bool(self.hits(x, y).sum() > self.share * max(len(x), len(y)))
        lo, hi = min(i, j), max(i, j)
        for w in (w for d in range(1, 9) for w in (lo - d, hi + d, lo + d)):
            if self.has(w) and self.nodes[w] not in (a, b):
                x, y = left(w)
                if max(len(x) / len(a), len(y) / len(b)) >= self.own_share:
                    return bool(self.hits(x, y).sum() > self.share * max(len(x), len(y)))
        return True

    def witnesses(self, i: int, step: int) -> Iterator[int]:
        """The nearest pages before (-1) or after (1) page i that have text and are no copies of it, one of a run of copies."""
        ends, unsure = (self.first, self.open_first) if step < 0 else (self.last, self.open_last)
        j = i
        found = 0
        for _ in range(RUNS):
            self.seen |= unsure[j]
            j = ends[j] + step
            if not self.has(j):
                return
            if self.nodes[j] and not (self.most(i, j) and self.copies(i, j)):
                yield j
                found += 1
                if found == WITNESSES:
                    return

    def template(self, i: int) -> np.ndarray:
        """Which blocks of page i go."""
        n = len(self.nodes[i])
        if not self.marked[i]:
            sides = []
            for step in (-1, 1):
                seen, votes = 0, np.zeros(n, np.int64)
                for j in self.witnesses(i, step):
                    votes += self.hits(self.nodes[i], self.nodes[j])
                    seen += 1
                sides.append((seen, 2 * votes > seen))
            # at a host's end, a side with a single page says little beside one with more
            least = min(2, max(seen for seen, _ in sides))
            return np.logical_or.reduce([shared_ for seen, shared_ in sides if seen >= least])
        gone, seen = np.ones(n, bool), 0
        for step in (-1, 1):
            for j in self.witnesses(i, step):
                gone &= self.hits(self.nodes[i], self.nodes[j])
                if not gone.any():
                    return gone
                seen += 1
        return gone if seen > 1 else np.zeros(n, bool)

    def reach(self, i: int, step: int) -> int:
        """The farthest page that the text of page i can depend on, on one side, if the host's end is not nearer."""
        ends = self.least if step < 0 else self.most_
        for _ in range(RUNS + 1):
            i = ends[i] + step
            if not 0 <= i < len(self.nodes):
                break
        return min(max(i + step * NEAR, 0), len(self.nodes) - 1)


#: A page with its text, one that waits for others, and one that others need.
_DONE, _OPEN, _BESIDE = 0, 1, 2


class _Part:
    """Pages of one host as they come, held until nothing that is still to come can change their texts.

    ``before``: the host may have begun in the range before. Then the first pages go to the second step, and so do the last
    ones if it may go on in the next range, each with all pages that they can depend on. Ranges have edges 0 and 1. If some
    page can depend on what is beyond both, all pages go with edge 0, and it is said that it joins edge 1.
    """

    def __init__(self, before: bool, copy_share: float, own_share: float):
        self.before, self.shares = before, (copy_share, own_share)
        self.rows: list[tuple] = []
        self.size, self.limit = 0, HELD

    def add(self, row: tuple) -> Iterator[tuple]:
        self.rows.append(row)
        self.size += _size(row)
        if self.size > self.limit:
            yield from self.settle(True, False)

    def send(self, a: int, b: int, node_of: list[int], asked: set[int], edge: int, joins: bool = False) -> Iterator[tuple]:
        """Pages of nodes a to b for the second step, which settles those of the nodes ``asked``."""
        for k, i in enumerate(node_of):
            if a <= i <= b:
                p = self.rows[k]
                kind = _OPEN if p[6] == _OPEN and i in asked else _BESIDE
                if kind == _OPEN:
                    self.rows[k] = (*p[:6], _BESIDE, *p[7:])
                yield p, kind, None, edge, joins

    def settle(self, more: bool, beyond: bool) -> Iterator[tuple]:
        """(page, kind, text, edge, joins) of what can be told; ``more``: pages are still to come, ``beyond``: there may be some in the next range."""
        host = _Host(self.rows, self.before, more or beyond, *self.shares)
        n, waits, texts = len(host.nodes), {}, {}
        for k, (p, i) in enumerate(zip(self.rows, host.node_of, strict=True)):
            if p[6] == _OPEN:
                if i not in waits:
                    gone, waits[i] = host.watched(host.template, i)
                    texts[i] = _SEP.join(t for t, g in zip(host.nodes[i], gone, strict=True) if not g)
                if not waits[i]:
                    yield p, _DONE, texts[i], None, None
                    self.rows[k] = (*p[:6], _BESIDE, *p[7:])
        early, late = ({i for i, w in waits.items() if w & side} for side in (_BEFORE, _AFTER))
        a, b = host.reach(min(late, default=n - 1), -1), host.reach(max(early, default=0), 1)
        apart = a > 0 and b < n - 1  # no page from a on looks before this range, none up to b behind it
        if self.before and beyond and not apart:
            yield from self.send(0, n - 1, host.node_of, early | late, 0, True)
            return
        if self.before and (not more or apart):
            yield from self.send(0, b, host.node_of, early - late, 0)
            self.before = False
        if beyond:
            yield from self.send(a, n - 1, host.node_of, late, 1)
        if more and not self.before:
            self.rows = self.rows[int(np.searchsorted(host.node_of, a)) :]
        self.size = sum(map(_size, self.rows))
        self.limit = max(HELD, 2 * self.size)


def _difference(rows: Iterator[tuple], ends_open: bool, copy_share: float, own_share: float, at: int = 0) -> Iterator[pa.RecordBatch]:
    """From pages in order of host and path, their texts without the template; the pages are those between the edges ``at`` and ``at + 1``.

    Rows may have an eighth value, which comes before the host in their order.
    """

    def parts():
        part = _Part(ends_open, copy_share, own_share)
        for r in rows:
            if not r[2]:
                yield r, _DONE, _SEP.join(r[4]), None, None
                continue
            if part.rows and (r[2], r[7:]) != (part.rows[-1][2], part.rows[-1][7:]):
                yield from part.settle(False, False)
                part = _Part(False, copy_share, own_share)
            yield from part.add(r)
        if part.rows:
            yield from part.settle(False, ends_open)
        elif ends_open:  # a range without pages of a host: what is beyond its edges meets
            yield (None,) * 7, _BESIDE, None, 0, True

    def settled():
        for p, kind, text, edge, joins in parts():
            yield (*p[:4], None, p[5], kind, text, None, None) if kind == _DONE else (*p[:6], kind, text, at + edge, joins)

    buf, n = [], 0
    for r in settled():
        buf.append(r)
        n += len(r[7] or "")
        if len(buf) == 200 or n > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buf, strict=True), _STEP, strict=True)], schema=_STEP)
            buf, n = [], 0
    if buf:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buf, strict=True), _STEP, strict=True)], schema=_STEP)


def _size(row: tuple) -> int:
    return 64 + sum(map(len, row[4]))


def extract(pages: DataFrame, copy_share: float = 0.8, own_share: float = 0.1) -> DataFrame:
    """(page_id, url, text) for each row of ``pages(page_id, url, html)``."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    src = src.select("page_id", "url", canonical_host(F.col("url")).alias("host"), canonical_path(F.col("url")).alias("path"), "html")
    scratch = Scratch(pages.sparkSession, "html")
    order = ("host", "path", "page_id", "url")

    @lean
    def ranges(batches):
        yield from _difference(_unpacked(batches), True, copy_share, own_share, TaskContext.get().partitionId())

    @lean
    def edges(batches):
        yield from _difference((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True)), False, copy_share, own_share)

    # parsed once for the ranges' bounds and once for the rows: less than keeping the parsed pages in between
    step = scratch.save(src.mapInArrow(_parse, _PARSED_SQL).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(ranges, _STEP_SQL), "ranges")
    edge, of = F.col("edge"), {}
    for e in sorted(r["edge"] for r in step.where("joins").select("edge").distinct().collect()):  # one for each range at most
        of[e + 1] = of.get(e, e)
    if of:
        edge = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in of.items() for v in pair]), edge), edge)
    rest = step.where((F.col("kind") != _DONE) & F.col("host").isNotNull()).withColumn("edge", edge).repartition("edge").sortWithinPartitions("edge", *order)
    rest = rest.select("page_id", "url", "host", "path", "lines", "marked", "kind", "edge")
    return step.where(F.col("kind") == _DONE).unionByName(rest.mapInArrow(edges, _STEP_SQL)).where(F.col("kind") == _DONE).select("page_id", "url", "text")
