"""Gradient-boosted trees: histogram training with monotone constraints, flattened into numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    """All nodes of all trees in one set of arrays: feature (-1: leaf), threshold, left, right, value; roots."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row of x."""
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
            out += self.value[at]
        return 1 / (1 + np.exp(-out))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: float = 5.0) -> Forest:
    """Logistic loss.  monotone: 1 (may only raise the score), -1 (only lower it) or 0 for each feature.

    A split on a constrained feature needs leaf values in the right order, and both sides keep a bound at their
    mid value, so no deeper split can undo it.
    """
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) == 0 or y.min() == y.max():
        p = 0.999 if len(y) == 0 or y[0] else 0.001
        return Forest(*(np.zeros(0, t) for t in (int, float, int, int, float)), np.zeros(0, int), float(np.log(p / (1 - p))), 0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    raw = np.full(len(y), base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def gain(g, h, v):
        return -(g * v + 0.5 * (h + l2) * v * v)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        v = leaf(gs, hs, low, high)
        nodes.append([-1, 0.0, me, me, rate * v])
        best = (1e-6 + gain(gs, hs, v), None)
        if level < depth and hs > 2 * least:
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(cuts[j]) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                got = gain(gl, hl, vl) + gain(gs - gl, hs - hl, vr)
                fits = (hl >= least) & (hs - hl >= least) & (monotone[j] * (vr - vl) >= 0)
                if fits.any() and (k := int(np.argmax(np.where(fits, got, -np.inf)))) is not None and got[k] > best[0]:
                    best = (got[k], (j, k, vl[k], vr[k]))
        if best[1] is not None:
            j, k, vl, vr = best[1]
            mid, goes = (vl + vr) / 2, binned[rows, j] <= k
            left, right = (low, mid), (mid, high)
            if monotone[j] == 0:
                left = right = (low, high)
            elif monotone[j] < 0:
                left, right = (mid, high), (low, mid)
            a = grow(rows[goes], g, h, level + 1, *left)
            b = grow(rows[~goes], g, h, level + 1, *right)
            nodes[me] = [j, float(cuts[j][k]), a, b, rate * v]
        return me

    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(y)), q - y, np.maximum(q * (1 - q), 1e-6), 0, -4.0, 4.0))
        start, n = roots[-1], np.array(nodes)
        at = np.full(len(y), start)
        for _ in range(depth):
            f = n[at, 0].astype(int)
            goes = x[np.arange(len(y)), np.maximum(f, 0)] <= n[at, 1]
            at = np.where(f >= 0, np.where(goes, n[at, 2], n[at, 3]), at).astype(int)
        raw += n[at, 4]
    n = np.array(nodes)
    return Forest(n[:, 0].astype(np.int64), n[:, 1], n[:, 2].astype(np.int64), n[:, 3].astype(np.int64), n[:, 4], np.array(roots), base, depth)
