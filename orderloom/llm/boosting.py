"""Gradient-boosted trees for binary labels on binned features, in NumPy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with histogram splits; trees are full binary trees of ``depth`` levels."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """One class or no rows give a constant score."""
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(x.shape[1])]
        if not len(y) or y.min() == y.max():
            return self
        b, f = self._bin(x), np.full(len(y), self.base)
        wide = self.bins
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            at = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, wide)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-9)
                for j in range(b.shape[1]):
                    key = at * wide + b[:, j]
                    sg = np.bincount(key, g, n * wide).reshape(n, wide).cumsum(1)
                    sh = np.bincount(key, h, n * wide).reshape(n, wide).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.smooth) + (tg - sg) ** 2 / (th - sh + self.smooth) - tg**2 / (th + self.smooth)
                    k = gain.argmax(1)
                    top = gain[np.arange(n), k]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + n][better], cut[first : first + n][better] = j, k[better]
                at = at * 2 + (b[np.arange(len(b)), feature[first + at]] > cut[first + at])
            leaf = np.bincount(at, g, 2**self.depth) / (np.bincount(at, h, 2**self.depth) + self.smooth)
            f += self.rate * leaf[at]
            self.nodes.append((feature, cut, self.rate * leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        b, f = self._bin(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = at * 2 + (b[rows, feature[node]] > cut[node])
            f += leaf[at]
        return 1 / (1 + np.exp(-f))
