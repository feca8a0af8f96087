"""Gradient-boosted trees for two classes, by histograms."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of one depth, kept as arrays; fitted to log loss with Newton leaf values."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, smooth: float = 1.0):
        self.trees, self.depth, self.rate, self.smooth = trees, depth, rate, smooth

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        inner, width = (1 << self.depth) - 1, x.shape[1]
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        margin = np.full(len(y), self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, n = (1 << level) - 1, 1 << level
                best = np.full(n, 1e-6)
                split = np.full(n, -1)
                for f in range(width):
                    key = (node - first) * BINS + bins[:, f]
                    g = np.bincount(key, grad, n * BINS).reshape(n, BINS).cumsum(1)
                    h = np.bincount(key, hess, n * BINS).reshape(n, BINS).cumsum(1)
                    value = lambda a, b: a * a / (b + self.smooth)
                    gain = value(g, h) + value(g[:, -1:] - g, h[:, -1:] - h) - value(g[:, -1:], h[:, -1:])
                    gain[:, len(edges[f]) :] = 0
                    k = gain.argmax(1)
                    better = gain[np.arange(n), k] > best
                    best = np.where(better, gain[np.arange(n), k], best)
                    split = np.where(better, f * BINS + k, split)
                for i in np.flatnonzero(split >= 0):
                    f, k = divmod(int(split[i]), BINS)
                    self.feature[t, first + i], self.cut[t, first + i] = f, edges[f][k]
                right = x[np.arange(len(y)), self.feature[t][node]] > self.cut[t][node]
                node = 2 * node + 1 + right
            leaf = node - inner
            g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
            self.leaf[t] = self.rate * g / (h + self.smooth)
            margin += self.leaf[t][leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        out, row, inner = np.full(len(x), self.base), np.arange(len(x)), (1 << self.depth) - 1
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, self.feature[t][node]] > self.cut[t][node])
            out += self.leaf[t][node - inner]
        return out
