"""Naive Bayes support vectors: indicators scaled by class log-count ratios, a linear hinge-loss model by dual coordinate descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Rows = list[np.ndarray]


@dataclass(frozen=True)
class Model:
    """A row of indicators has the margin sum(weight) / sqrt(1 + sum(square)) + bias, and the probability 1 / (1 + exp(-(slope * margin + shift)))."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
        """Margins of `rows` rows; row and code list their indicators."""
        total = np.bincount(row, self.weight[code], rows)
        return total / np.sqrt(1 + np.bincount(row, self.square[code], rows)) + self.bias

    def score(self, row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(row, code, rows) + self.shift, -500, 500)))


def ratios(x: Rows, y: np.ndarray, size: int, prior: float = 1.0) -> np.ndarray:
    """Of each indicator the log of its share of rows with y = 1 over that of rows with y = 0, with `prior` rows added to each."""
    share = []
    for kind in (1, 0):
        own = [x[i] for i in np.flatnonzero(y == kind).tolist()]
        count = np.bincount(np.concatenate(own), minlength=size) if own else np.zeros(size)
        share.append((count + prior) / (len(own) + 2 * prior))
    return np.log(share[0] / share[1])


def descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 30, close: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, dual variables) of the least |w|**2 / 2 + bias**2 / 2 + cost * sum(max(0, 1 - y * (w x + bias))).

    x: (places, values) of each row; y: 1 or -1.  One dual variable after another goes to its best value between 0 and
    `cost`; the rounds end when all stay within `close` of optimal.
    """
    w, bias, dual = np.zeros(size), 0.0, np.zeros(len(x))
    square = [float(v @ v) + 1 for _, v in x]
    dealt = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in dealt.permutation(len(x)).tolist():
            at, v = x[i]
            slope = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), cost)
            most = max(most, abs(min(slope, 0) if dual[i] == 0 else max(slope, 0) if dual[i] == cost else slope))
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[at] += step * v
                bias, dual[i] = bias + step, new
        if most <= close:
            break
    return w, bias, dual


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the probability of y = 1 by margin, for targets drawn in by one row of each kind; by Newton's method."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    at = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(at):
        z = x @ at
        return float((np.logaddexp(0, z) - t * z).sum() + 1e-6 * at @ at)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (p - t) + 2e-6 * at
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2), slope)
        size, now = 1.0, loss(at)
        while size > 1e-6 and loss(at - size * step) > now:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(at[0], 0.0)), float(at[1])


def fitted(x: Rows, y: np.ndarray, size: int, cost: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(ratio of each indicator, weight of each scaled indicator, bias)."""
    r = ratios(x, y, size)
    scaled = [(at, r[at] / np.sqrt(1 + r[at] @ r[at])) for at in x]
    w, bias, _ = descend(scaled, np.where(y == 1, 1.0, -1.0), size, cost)
    return r, w, bias


def train(x: Rows, y: np.ndarray, size: int, cost: float = 1.0, folds: int = 4) -> Model:
    """x: distinct indicators (below `size`) of each row; y: 0 or 1.  Probabilities are fitted to margins of rows that were left out."""
    zero = np.zeros(size)
    if len(y) == 0 or y.min() == y.max():
        p = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(zero, zero, 0.0, 0.0, float(np.log(p / (1 - p))))

    def model(own: np.ndarray) -> Model:
        r, w, bias = fitted([x[i] for i in own.tolist()], y[own], size, cost)
        return Model(r * w, r * r, bias, 1.0, 0.0)

    def margins(m: Model, own: np.ndarray) -> np.ndarray:
        rows = [x[i] for i in own.tolist()]
        return m.margins(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows]), len(rows))

    whole, place, out = model(np.arange(len(y))), np.arange(len(y)), np.zeros(len(y))
    for kind in (0, 1):  # folds of each kind alike
        place[y == kind] = np.arange((y == kind).sum()) % folds
    for k in range(folds):
        left, rest = np.flatnonzero(place == k), np.flatnonzero(place != k)
        if len(left):
            out[left] = margins(model(rest) if len(np.unique(y[rest])) == 2 else whole, left)
    slope, shift = logistic(out, y)
    return Model(whole.weight, whole.square, whole.bias, slope, shift)
