"""Small linear models in numpy: logistic regression over dense or hashed sparse features."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60, bias: bool = True) -> np.ndarray:
    """Weights (and a bias, last) of a logistic regression by Newton's method with backtracking."""
    a = np.hstack([x, np.ones((len(x), 1))]) if bias else x
    w = np.zeros(a.shape[1])
    reg = np.full(a.shape[1], l2)
    if bias:
        reg[-1] = 1e-9

    def loss(v):
        z = a @ v
        return np.mean(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(reg * v * v)

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (p - y) / len(y) + reg * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(reg + 1e-9)
        d = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-4 and loss(w - t * d) > now - 1e-4 * t * (g @ d):
            t /= 2
        w = w - t * d
        new = loss(w)
        if now - new < 1e-9:
            break
        now = new
    return w


class Rows:
    """Sparse rows: ``idx`` and ``val`` of all rows, and ``off`` (rows + 1) into them."""

    def __init__(self, idx: np.ndarray, val: np.ndarray, off: np.ndarray):
        self.idx, self.val, self.off = idx, val, off
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(off))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.idx] * self.val, len(self.off) - 1)

    def t_dot(self, r: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.idx, r[self.row] * self.val, n)

    def pick(self, keep: np.ndarray) -> Rows:
        m = keep[self.row]
        return Rows(self.idx[m], self.val[m], np.concatenate([[0], np.cumsum(np.diff(self.off)[keep])]))


def fit_sparse(x: Rows, extra: np.ndarray, y: np.ndarray, n: int, l2: float, weight: np.ndarray, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Weights over ``n`` hashed features, and over the dense ``extra`` columns with a bias, by L-BFGS."""
    k = extra.shape[1]
    a = np.hstack([extra, np.ones((len(y), 1))])
    total = weight.sum()

    def f(v):
        z = x.dot(v[:n]) + a @ v[n:]
        r = weight * (sigmoid(z) - y) / total
        g = np.concatenate([x.t_dot(r, n), a.T @ r])
        g[: n + k] += l2 * v[: n + k]
        return np.sum(weight * (np.logaddexp(0, z) - y * z)) / total + 0.5 * l2 * np.sum(v[: n + k] ** 2), g

    v = np.zeros(n + k + 1)
    now, g = f(v)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, al = g.copy(), []
        for s, u in reversed(past):
            al.append((s @ q) / (s @ u))
            q -= al[-1] * u
        if past:
            s, u = past[-1]
            q *= (s @ u) / (u @ u)
        for (s, u), c in zip(past, reversed(al), strict=True):
            q += (c - (u @ q) / (s @ u)) * s
        t = 1.0
        while True:
            new, g2 = f(v - t * q)
            if new <= now - 1e-4 * t * (g @ q) or t < 1e-6:
                break
            t /= 2
        s, u = -t * q, g2 - g
        if s @ u > 1e-12:
            past = [*past[-7:], (s, u)]
        v, g, gain, now = v - t * q, g2, now - new, new
        if gain < 1e-8:
            break
    return v[:n], v[n:]
