"""Gradient-boosted trees on histograms, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def _grow(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, least: float, l2: float) -> tuple:
    """A complete tree of ``depth`` levels: (feature, cut) of each inner node, value of each leaf."""
    n, d = binned.shape
    feature, cut = np.zeros(2**depth, dtype=np.int64), np.full(2**depth, np.inf)
    node = np.ones(n, dtype=np.int64)
    for level in range(depth):
        for at in range(2**level, 2 ** (level + 1)):
            rows = np.flatnonzero(node == at)
            g, h = grad[rows].sum(), hess[rows].sum()
            best, chosen = 1e-9, None
            for j in range(d):
                if len(cuts[j]) == 0 or len(rows) == 0:
                    continue
                size = len(cuts[j]) + 1
                gl = np.cumsum(np.bincount(binned[rows, j], grad[rows], size))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], hess[rows], size))[:-1]
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                gain[(hl < least) | (h - hl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, chosen = gain[k], (j, k)
            if chosen is None:
                node[rows] = 2 * at
                continue
            j, k = chosen
            feature[at], cut[at] = j, cuts[j][k]
            node[rows] = 2 * at + (binned[rows, j] > k)
    leaf = node - 2**depth
    g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
    return feature, cut, -g / (h + l2)


class BoostedTrees:
    """Trees for the log odds of label 1."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least: float = 1.0, l2: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2
        self.trees: list[tuple] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        cuts = _cuts(x, self.bins)
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-margin))
            feature, cut, value = _grow(binned, q - y, q * (1 - q), cuts, self.depth, self.least, self.l2)
            self.trees.append((feature, cut, self.rate * value))
            margin += self._one(x, self.trees[-1])
        return self

    def _one(self, x: np.ndarray, tree: tuple) -> np.ndarray:
        feature, cut, value = tree
        node = np.ones(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + (x[rows, feature[node]] > cut[node])
        return value[node - 2**self.depth]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for tree in self.trees:
            margin += self._one(x, tree)
        return 1 / (1 + np.exp(-margin))


class Isotonic:
    """The nondecreasing step function nearest to the labels, joined by straight lines."""

    def fit(self, p: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(p, kind="stable")
        blocks: list[list[float]] = []  # sum of y, count, sum of p
        for i in order:
            blocks.append([float(y[i]), 1.0, float(p[i])])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.array([b[0] / b[1] for b in blocks])
        return self

    def __call__(self, p: np.ndarray) -> np.ndarray:
        return np.interp(p, self.x, self.y)
