"""Suffix arrays in numpy: suffix order, common prefixes and longest previous factors of a number sequence.

Zeros are separators: each differs from all others and stands below everything else, in the order of their
positions, so no common prefix crosses one.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray, ranks: list[tuple[int, np.ndarray]] | None = None) -> np.ndarray:
    """Suffix order of a sequence of numbers >= 0, by prefix doubling.

    The first round packs as many numbers as 62 bits hold; later ones sort only suffixes whose place is not
    settled. ``ranks`` collects (h, ranks by the first h numbers), from which ``common_prefixes`` works.
    """
    n = len(seq)
    bits = max(1, int(seq.max(initial=0)).bit_length())
    packed = max(1, 62 // bits)
    key, live = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(packed):
        here = np.zeros(n, np.int64)
        here[: max(0, n - k)] = seq[k:]
        here[~live] = 0
        key = (key << np.int64(bits)) | here
        live &= here != 0
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    order = np.argsort(key, kind="stable")
    sa, key = order.copy(), key[order]
    new = ~live[order]  # a separator among the first numbers: no other suffix begins alike
    new[:1] = True
    new[1:] |= key[1:] != key[:-1]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    active = order[~(new & np.append(new[1:], True))]
    h = packed
    while True:
        if ranks is not None:
            ranks.append((h, rank.astype(np.int32)))
        if not len(active):
            return sa
        second = rank[np.minimum(active + h, n)]
        key = (rank[active] << np.int64(32)) | (second + 1)
        o = np.argsort(key, kind="stable")
        active, key = active[o], key[o]
        base = key >> np.int64(32)
        group = np.ones(len(active), bool)
        group[1:] = base[1:] != base[:-1]
        sub = np.ones(len(active), bool)
        sub[1:] = key[1:] != key[:-1]
        i = np.arange(len(active))
        in_group = i - np.maximum.accumulate(np.where(group, i, 0))
        sa[base + in_group] = active
        place = base + in_group
        rank[active] = place[np.maximum.accumulate(np.where(sub, i, 0))]
        active = active[~(sub & np.append(sub[1:], True))]
        h *= 2


def pair_prefixes(seq: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, pair by pair; no pair may be of equals."""
    length = np.zeros(len(a), np.int64)
    for h, r in reversed(ranks):
        length += np.where(r[a + length] == r[b + length], h, 0)
    open_, n = np.arange(len(a)), len(seq)
    for _ in range(ranks[0][0] - 1):  # fewer numbers than the first round packs
        x, y = a[open_] + length[open_], b[open_] + length[open_]
        inside = (x < n) & (y < n)
        same = np.zeros(len(open_), bool)
        same[inside] = (seq[x[inside]] == seq[y[inside]]) & (seq[x[inside]] != 0)
        open_ = open_[same]
        if not len(open_):
            break
        length[open_] += 1
    return length


def common_prefixes(seq: np.ndarray, sa: np.ndarray, ranks: list[tuple[int, np.ndarray]], least: int = 1) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in suffix order; those under ``least`` may be 0."""
    n = len(sa)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    first = [r for h, r in ranks if h <= least]
    todo = np.arange(1, n)
    if first:
        todo = todo[first[-1][sa[1:]] == first[-1][sa[:-1]]]
    out[todo] = pair_prefixes(seq, ranks, sa[todo - 1], sa[todo])
    return out


def previous_factors(sa: np.ndarray, prefixes: np.ndarray, place: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factor of each suffix: its longest common prefix with a suffix of a smaller ``place``.

    The best match is the previous or the next entry of a smaller place in suffix order. Both are found for
    all entries at once by jumping over entries of larger places, as far as ``least`` numbers are common;
    shorter factors are 0. The result is by position, as ``place`` is.
    """
    n = len(sa)
    where, best = place[sa], np.zeros(n, np.int64)
    for step in (-1, 1):
        at = np.arange(n) + step
        common = prefixes.copy() if step < 0 else np.append(prefixes[1:], 0)
        live = np.flatnonzero(common >= least)
        while len(live):
            live = live[where[at[live]] > where[live]]
            via = at[live]
            reach, beyond = np.minimum(common[live], common[via]), at[via]
            common[live], at[live] = reach, beyond
            live = live[reach >= least]
        best = np.maximum(best, np.where(common >= least, common, 0))
    out = np.empty(n, np.int64)
    out[sa] = best
    return out


def longest_matches(old: bytes, new: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each position of ``new``, the length and the place in ``old`` of the longest match that starts there."""
    return longest_matches_many([(old, new)])[0]


def longest_matches_many(pairs: list[tuple[bytes, bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``longest_matches`` of each pair (old, new), from one suffix array: each pair has letters of its own."""
    parts, cut = [], np.zeros(1, np.int64)
    for i, (old, new) in enumerate(pairs):
        for raw in (old, new):
            parts += [np.frombuffer(raw, np.uint8).astype(np.int64) + (256 * i + 1), cut]
    seq = np.concatenate(parts) if parts else cut
    sizes = np.array([[len(old) + 1, len(new) + 1] for old, new in pairs], np.int64).reshape(-1, 2)
    starts = np.cumsum(sizes.ravel()) - sizes.ravel()
    part = np.repeat(np.arange(2 * len(pairs)), sizes.ravel())  # even: old, odd: new
    ranks: list = []
    sa = suffix_array(seq, ranks)
    n = len(seq)
    of, text = part[sa] if len(pairs) else sa, seq[sa] > 0
    is_old = text & (of % 2 == 0)
    before = np.maximum.accumulate(np.where(is_old, np.arange(n), -1))
    after = np.minimum.accumulate(np.where(is_old, np.arange(n), n)[::-1])[::-1]
    mine = np.flatnonzero(text & (of % 2 == 1))
    size, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for beside in (before, after):
        k = mine[(beside[mine] >= 0) & (beside[mine] < n)]
        k = k[of[beside[k]] == of[k] - 1]
        at, other = sa[k], sa[beside[k]]
        length = pair_prefixes(seq, ranks, at, other)
        better = length > size[at]
        size[at[better]], place[at[better]] = length[better], (other - starts[of[k] - 1])[better]
    return [(size[s : s + len(new)], place[s : s + len(new)]) for s, (_, new) in zip(starts[1::2].tolist(), pairs, strict=True)]
