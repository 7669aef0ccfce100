"""Gradient-boosted trees for small feature tables, with isotonic calibration, in numpy.

Ties between equally good splits go to the first feature and lowest bin; a constant feature is never
split; without rows of both labels fit() raises ValueError. A missing value (nan) goes left.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier: logistic loss, histogram splits, trees of a fixed depth stored as flat arrays."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, penalty: float = 1.0, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if len(y) == 0 or y.min() == y.max():
            raise ValueError("rows of both labels are needed")
        x = np.nan_to_num(np.asarray(x, float), nan=-np.inf)
        self.edges = [np.unique(np.quantile(np.where(np.isfinite(c), c, 0), np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        width = max(len(e) for e in self.edges) + 1  # histograms of all features stand side by side
        flat = binned + np.arange(binned.shape[1]) * width
        mean = y.mean()
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.iinfo(np.int64).max)
        self.value = np.zeros((self.trees, inner + 1))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for at in range(inner):
                if len(rows := np.flatnonzero(node == at)):
                    self.feature[t, at], self.cut[t, at] = self._split(flat[rows], width, g[rows], h[rows])
                    right = binned[rows, self.feature[t, at]] > self.cut[t, at]
                    node[rows] = 2 * at + 1 + right
            leaf = node - inner
            total = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.penalty)
            self.value[t] = self.rate * total
            score += self.value[t][leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def _split(self, flat: np.ndarray, width: int, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        features = flat.shape[1]
        gain_of = lambda a, b: a * a / (b + self.penalty)
        sums = lambda v: np.cumsum(np.bincount(flat.ravel(), np.repeat(v, features), features * width).reshape(features, width), axis=1)[:, :-1]
        gl, hl = sums(g), sums(h)
        gain = gain_of(gl, hl) + gain_of(g.sum() - gl, h.sum() - hl) - gain_of(g.sum(), h.sum())
        gain[(hl < self.least) | (h.sum() - hl < self.least)] = -1
        feature, cut = divmod(int(gain.argmax()), width - 1) if gain.size else (0, 0)
        return (feature, cut) if gain.size and gain[feature, cut] > 1e-9 else (0, np.iinfo(np.int64).max)

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(np.asarray(x, float).reshape(len(x), len(self.edges)), nan=-np.inf)
        binned, score, inner = self._bin(x), np.full(len(x), self.start), 2**self.depth - 1
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[np.arange(len(x)), self.feature[t, node]] > self.cut[t, node])
            score += self.value[t][node - inner]
        return score


class Isotonic:
    """Calibrated probability as a non-decreasing step function of a score (pool adjacent violators)."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        pools: list[list[float]] = []  # weight, sum, least score
        for s, v in sorted(zip(score.tolist(), y.tolist())):
            pools.append([1.0, v, s])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                w, total, _ = pools.pop()
                pools[-1][0] += w
                pools[-1][1] += total
        self.at = np.array([p[2] for p in pools])
        self.p = np.array([(p[1] + 0.5) / (p[0] + 1) for p in pools])  # a pool of one kind never claims certainty
        self.p = np.maximum.accumulate(self.p)
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return self.p[np.clip(np.searchsorted(self.at, score, side="right") - 1, 0, None)]
