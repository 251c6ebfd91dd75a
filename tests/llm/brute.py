"""Plain Python versions of the contracts, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def decontaminate(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(item))
    lengths = {len(k) for k in windows}
    out = {}
    for d, text in docs:
        w = word.findall(lower(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def vectors(rows, threshold=0.98):
    ok = {i: v for i, v, lab in rows if lab is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = []
    ids = sorted(ok)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if label[a] == label[b] and len(ok[a]) == len(ok[b]):
                p, q = ok[a], ok[b]
                if sum(s * t for s, t in zip(p, q, strict=True)) / math.sqrt(sum(s * s for s in p) * sum(t * t for t in q)) >= threshold:
                    links.append((a, b))
    n = Counter(x for e in links for x in e)
    comp = roots([r[0] for r in rows], links)
    return {i: (n[i], comp[i], comp[i] == i) for i, _, _ in rows}


def repeats(docs, length=200, keep_first=False):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = defaultdict(list)
    for k, (_, b) in enumerate(raw):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].append((k, i))
    gone = [bytearray(len(b)) for _, b in raw]
    for places in seen.values():
        for k, i in places[1:] if keep_first else places if len(places) > 1 else ():
            gone[k][i : i + length] = b"\1" * length
    out = {}
    for (d, b), g in zip(raw, gone, strict=True):
        spans = len(re.findall(b"\1+", bytes(g)))
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        out[d] = (len(b), sum(g), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def near(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    both = Counter()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[(a, b)] += 1
    links = [(a, b) for (a, b), k in both.items() if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]
    comp = roots(list(sets), links)
    return {d: (len(sets[d]), comp[d], comp[d] == d) for d in sets}
