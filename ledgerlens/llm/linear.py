"""Small linear models, fitted on the driver from bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: the entries of row i are at[start[i]:start[i + 1]] with value[...]."""

    at: np.ndarray
    value: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        sizes = [len(a) for a, _ in rows]
        start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at = np.concatenate([a for a, _ in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
        value = np.concatenate([v for _, v in rows]).astype(float) if rows else np.empty(0)
        return Rows(at, value, start)

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, chosen: np.ndarray) -> Rows:
        return Rows.of([(self.at[self.start[i] : self.start[i + 1]], self.value[self.start[i] : self.start[i + 1]]) for i in chosen])

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.value * w[self.at])])
        return total[self.start[1:]] - total[self.start[:-1]]

    def transposed_dot(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, weights=self.value * np.repeat(g, np.diff(self.start)), minlength=size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float

    def logit(self, x: Rows) -> np.ndarray:
        return x.dot(self.weights) + self.bias


def fit_logistic(x: Rows, y: np.ndarray, size: int, l2: float = 1e-3, steps: int = 120, weight: np.ndarray | None = None) -> Logistic:
    """Balanced logistic regression by accelerated gradient steps; deterministic."""
    n, positives = len(y), float(y.sum())
    if n == 0 or positives in (0.0, float(n)):
        prior = (positives + 0.5) / (n + 1.0)
        return Logistic(np.zeros(size), float(np.log(prior / (1 - prior))))
    balance = np.where(y > 0, n / (2 * positives), n / (2 * (n - positives)))
    balance = balance if weight is None else balance * weight
    total = balance.sum()
    norms = np.add.reduceat(np.append(x.value**2, 0.0), np.minimum(x.start[:-1], len(x.value))) * (np.diff(x.start) > 0)
    rate = 1.0 / (0.25 * float((norms + 1).max()) + l2)
    w, b = np.zeros(size), 0.0
    vw, vb = w.copy(), b
    for k in range(steps):
        g = balance * (sigmoid(x.dot(vw) + vb) - y) / total
        nw, nb = vw - rate * (x.transposed_dot(g, size) + l2 * vw), vb - rate * float(g.sum())
        ahead = k / (k + 3.0)
        vw, vb = nw + ahead * (nw - w), nb + ahead * (nb - b)
        w, b = nw, nb
    return Logistic(w, float(b))


def fit_platt(logits: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * logit + b) is calibrated on these rows; a stays above 0."""
    n, positives = len(y), float(y.sum())
    if n == 0 or positives in (0.0, float(n)):
        return 1.0, 0.0
    target = np.where(y > 0, (positives + 1) / (positives + 2), 1 / (n - positives + 2))
    scale = max(float(np.abs(logits).max()), 1e-9)
    z, a, b = logits / scale, 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        r, s = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[np.sum(s * z * z) + 1e-6, np.sum(s * z)], [np.sum(s * z), np.sum(s) + 1e-6]])
        move = np.linalg.solve(h, [np.sum(r * z) + 1e-6 * a, np.sum(r)])
        move *= min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return max(a / scale, 1e-6), b
