"""Gradient-boosted regression trees for binary classes on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting; trees of fixed depth over quantile bins, stored as flat arrays."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(self.n):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
            node = np.zeros(len(y), dtype=np.int64)
            feature = np.zeros(2**self.depth - 1, dtype=np.int64)
            cut = np.full(2**self.depth - 1, self.bins, dtype=np.int64)
            for level in range(self.depth):
                k, at = 2**level, 2**level - 1
                best = np.zeros(k)
                for j in range(x.shape[1]):
                    cell = node * self.bins + b[:, j]
                    gs = np.cumsum(np.bincount(cell, g, k * self.bins).reshape(k, -1), axis=1)
                    hs = np.cumsum(np.bincount(cell, h, k * self.bins).reshape(k, -1), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.least) + (gt - gs) ** 2 / (ht - hs + self.least) - gt**2 / (ht + self.least)
                    c = gain.argmax(1)
                    got = gain[np.arange(k), c]
                    up = got > best + 1e-9
                    best[up], feature[at : at + k][up], cut[at : at + k][up] = got[up], j, c[up]
                node = 2 * node + (b[np.arange(len(y)), feature[at + node]] > cut[at + node])
            leaf = self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.least)
            f += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        rows, f = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (b[rows, feature[at]] > cut[at])
            f += leaf[node]
        return f
