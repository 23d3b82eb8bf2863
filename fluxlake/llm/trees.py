"""Small classification trees and forests on numpy arrays."""

from __future__ import annotations

import numpy as np


class Tree:
    """A binary tree on feature columns; a leaf holds the share of class 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int, least: int = 1, rng: np.random.Generator | None = None, tried: int | None = None):
        self.feature, self.cut, self.yes, self.no, self.share = [], [], [], [], []
        self._grow(np.asarray(x, float), np.asarray(y, float), depth, least, rng, tried)
        self.feature, self.yes, self.no = (np.array(v, np.int64) for v in (self.feature, self.yes, self.no))
        self.cut, self.share = np.array(self.cut), np.array(self.share)

    def _grow(self, x, y, depth, least, rng, tried) -> int:
        me = len(self.feature)
        for v, start in ((self.feature, -1), (self.cut, 0.0), (self.yes, 0), (self.no, 0), (self.share, float(y.mean()) if len(y) else 0.0)):
            v.append(start)
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return me
        among = np.arange(x.shape[1]) if tried is None else np.sort(rng.choice(x.shape[1], min(tried, x.shape[1]), replace=False))
        best = (1e-12, -1, 0.0)
        n, total = len(y), y.sum()
        whole = total * (n - total) / n
        for j in among:
            order = np.argsort(x[:, j], kind="stable")
            v, c = x[order, j], np.cumsum(y[order])[:-1]
            k = np.arange(1, n)
            gain = whole - (c * (k - c) / k + (total - c) * (n - k - total + c) / (n - k))
            gain[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), int(j), float((v[i] + v[i + 1]) / 2))
        if best[1] < 0:
            return me
        self.feature[me], self.cut[me] = best[1], best[2]
        left = x[:, best[1]] <= best[2]
        self.yes[me] = self._grow(x[left], y[left], depth - 1, least, rng, tried)
        self.no[me] = self._grow(x[~left], y[~left], depth - 1, least, rng, tried)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.share[at]
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= self.cut[at]
            at = np.where(inner, np.where(go, self.yes[at], self.no[at]), at)


class Forest:
    """Trees on bootstrap samples, each split among a random subset of the features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, seed: int = 7):
        rng = np.random.default_rng(seed)
        tried = max(1, int(np.sqrt(x.shape[1])) + 1)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(Tree(x[rows], y[rows], depth, 1, rng, tried))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum(t.predict(x) for t in self.trees) / len(self.trees)
