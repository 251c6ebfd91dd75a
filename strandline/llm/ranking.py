"""Logistic loss over all pairs of a preferred and another row, without forming a pair.

The model is a linear score. The loss of a pair is a function of the difference of two scores, analytic within pi of
the real line, so between cells of width one it is interpolated from ``NODES`` Chebyshev points in each score, with an
error near 1e-13. Rows count only by their weights on those points: sums that any number of tasks can add up.

Rows stay where they are. A ``Sweep`` applies a function to all blocks (x, y) of rows and returns the sum (``add``) of
what it gives, or None if there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from strandline.llm.linear import sigmoid

Sweep = Callable[[Callable[[np.ndarray, np.ndarray], object]], object]

NODES, EDGES = 12, 2048
_AT = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES) / 2
_BARY = (-1.0) ** np.arange(NODES) * np.sin((np.arange(NODES) + 0.5) * np.pi / NODES)


def _weights(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each score's cell, and its weights on the points of that cell."""
    cell = np.floor(s)
    d = (s - cell - 0.5)[:, None] - _AT
    hit = d == 0
    q = _BARY / np.where(hit, 1, d)
    on = hit.any(1)
    q[on] = hit[on]
    return cell.astype(np.int64), q / q.sum(1, keepdims=True)


def _cells(s: np.ndarray, y: np.ndarray):
    """(class, cell), the rows in it, and their weights."""
    cell, q = _weights(s)
    order = np.lexsort((cell, y))
    key = np.stack([y[order], cell[order]], 1)
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(order) else np.zeros(0, np.int64)
    for i, j in zip(first, np.r_[first[1:], len(order)], strict=True):
        rows = order[i:j]
        yield (int(key[i, 0]), int(key[i, 1])), rows, q[rows]


def add(a, b):
    """Sum of what two blocks gave: numbers, arrays, tuples, or dicts of them."""
    if isinstance(a, dict):
        return a | {k: add(a[k], v) if k in a else v for k, v in b.items()}
    if isinstance(a, tuple):
        return tuple(add(x, y) for x, y in zip(a, b, strict=True))
    return a + b


def _side(sums: dict, cls: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Points, and sums on them, of one class."""
    cells = sorted(c for y, c in sums if y == cls)
    return np.concatenate([c + 0.5 + _AT for c in cells]), np.concatenate([sums[cls, c] for c in cells]), cells


def fit_pairs(sweep: Sweep, wide: Callable[[np.ndarray], np.ndarray], width: int, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights over ``wide(x)`` (``width`` columns) by Newton's method: mean loss of all pairs (y = 1, y = 0) and ``l2``."""

    def look(w):
        """Loss and gradient, and what the curvature needs."""

        def block(x, y):
            z = wide(x)
            one = np.hstack([np.ones((len(z), 1)), z])
            return {k: q.T @ one[rows] for k, rows, q in _cells(z @ w, y)}

        sums = sweep(block)
        (at, good, cells), (bt, bad, others) = _side(sums, 1), _side(sums, 0)
        pairs = good[:, 0].sum() * bad[:, 0].sum()
        loss, grad, cross = 0.0, np.zeros(width), np.zeros((width, width))
        curve, back = {}, np.zeros(len(bt))
        for k, c in enumerate(cells):  # a cell at a time: the table of all points by all points may be large
            i = slice(k * NODES, (k + 1) * NODES)
            u = at[i, None] - bt[None]
            p = sigmoid(-u)
            loss += good[i, 0] @ np.logaddexp(0, -u) @ bad[:, 0]
            grad += (p.T @ good[i, 0]) @ bad[:, 1:] - (p @ bad[:, 0]) @ good[i, 1:]
            h = p * (1 - p)
            curve[1, c] = h @ bad[:, 0]
            back += h.T @ good[i, 0]
            cross += good[i, 1:].T @ h @ bad[:, 1:]
        curve |= {(0, c): back[k * NODES : (k + 1) * NODES] for k, c in enumerate(others)}
        return loss / pairs + 0.5 * l2 * w @ w, grad / pairs + l2 * w, (curve, cross, pairs)

    def bend(w, curve, cross, pairs):
        def block(x, y):
            z = wide(x)
            c = np.zeros(len(z))
            for k, rows, q in _cells(z @ w, y):
                c[rows] = q @ curve[k]
            return (z * c[:, None]).T @ z

        return (sweep(block) - cross - cross.T) / pairs + l2 * np.eye(width)

    w = np.zeros(width)
    now, g, more = look(w)
    for _ in range(steps):
        d = np.linalg.solve(bend(w, *more), g)
        t = 1.0
        new, g2, more = look(w - d)
        while t > 1e-4 and new > now - 1e-4 * t * (g @ d):
            t /= 2
            new, g2, more = look(w - t * d)
        w, g, gain, now = w - t * d, g2, now - new, new
        if gain < 1e-9:
            break
    return w


def quantiles(sweep: Sweep, score: Callable[[np.ndarray], np.ndarray], bound: float, n: int, qs: list[float]) -> list[float]:
    """As ``np.quantile`` of the scores, within ``bound`` of zero, of all ``n`` rows: ranks are counted between ever closer edges, to the last bit."""
    places = [q * (n - 1) for q in qs]
    found = {r: (-bound, bound) for p in places for r in (int(np.floor(p)), int(np.ceil(p)))}
    # a rank's value is above its lower bound and at most its upper one
    while any(np.nextafter(a, np.inf) < b for a, b in found.values()):
        edges = {r: np.unique(np.linspace(a, b, EDGES + 1)) for r, (a, b) in found.items()}

        def block(x, y, edges=edges):
            s = np.sort(score(x))
            return {r: np.searchsorted(s, e, "right") for r, e in edges.items()}

        upto = sweep(block)
        for r, e in edges.items():
            j = int(np.searchsorted(upto[r], r + 1))
            found[r] = (e[j - 1], e[j])
    value = {r: b for r, (_, b) in found.items()}
    return [float(value[int(np.floor(p))] + (p - np.floor(p)) * (value[int(np.ceil(p))] - value[int(np.floor(p))])) for p in places]
