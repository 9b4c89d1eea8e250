"""Gradient-boosted regression trees for a binary target, in numpy."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, RATE, BINS, MIN_WEIGHT, SMOOTH = 40, 4, 0.25, 32, 5.0, 1.0


class BoostedTrees:
    """Logistic loss, second-order leaf values, complete trees in level order."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        n, f = x.shape
        self.depth = depth
        share = (y.sum() + 0.5) / (n + 1.0)
        self.base = float(np.log(share / (1 - share)))
        inner = 2 ** depth - 1
        self.feature = np.zeros((trees, inner), np.int32)
        self.cut = np.full((trees, inner), np.inf)
        self.value = np.zeros((trees, inner + 1))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0)
                for j in range(f)]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) \
            if n else np.zeros((0, f), np.int64)
        score = np.full(n, self.base)
        flat = np.arange(f)[None, :] * BINS
        for t in range(trees if n and 0 < y.sum() < n else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, width = 2 ** level - 1, 2 ** level
                slot = ((node - first)[:, None] * (f * BINS) + flat + code).reshape(-1)
                size = width * f * BINS
                gs = np.bincount(slot, np.repeat(g, f), size).reshape(width, f, BINS).cumsum(axis=2)
                hs = np.bincount(slot, np.repeat(h, f), size).reshape(width, f, BINS).cumsum(axis=2)
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs ** 2 / (hs + SMOOTH) + (gt - gs) ** 2 / (ht - hs + SMOOTH) - gt ** 2 / (ht + SMOOTH)
                gain[(hs < MIN_WEIGHT / 10) | (ht - hs < MIN_WEIGHT / 10)] = 0.0
                best = gain.reshape(width, -1).argmax(axis=1)
                for k in range(width):
                    j, b = divmod(int(best[k]), BINS)
                    self.feature[t, first + k] = j
                    if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                        self.cut[t, first + k] = cuts[j][b]
                node = 2 * node + 1 + (x[np.arange(n), self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            self.value[t] = RATE * gs / (hs + SMOOTH)
            score += self.value[t, leaf]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the target for each row."""
        score, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2 ** self.depth - 1
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - inner]
        return 1 / (1 + np.exp(-score))
