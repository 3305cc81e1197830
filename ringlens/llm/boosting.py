"""Small gradient-boosted trees for two classes, on binned features, as numpy arrays."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Full binary trees of one depth; nodes that are not worth a split send all rows left."""

    def __init__(self, rounds: int = 90, depth: int = 4, rate: float = 0.2, penalty: float = 1.0, least: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.penalty, self.least = rounds, depth, rate, penalty, least
        self.cuts: list[np.ndarray] = []
        self.features: list[np.ndarray] = []
        self.bins: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(column, quantiles)) for column in x.T]
        binned = self._binned(x)
        count, width = binned.shape
        offsets = np.arange(width) * BINS
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(count, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = p - y, p * (1 - p)
            node = np.zeros(count, dtype=np.int64)
            features, bins = [], []
            for level in range(self.depth):
                nodes = 1 << level
                places = ((node * width * BINS)[:, None] + offsets + binned).ravel()
                size = nodes * width * BINS
                g = np.bincount(places, np.repeat(gradient, width), size).reshape(nodes, width, BINS).cumsum(axis=2)
                h = np.bincount(places, np.repeat(weight, width), size).reshape(nodes, width, BINS).cumsum(axis=2)
                total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + self.penalty) + (total_g - g) ** 2 / (total_h - h + self.penalty) - total_g**2 / (total_h + self.penalty)
                gain[(h < self.least) | (total_h - h < self.least)] = 0
                flat = gain.reshape(nodes, -1)
                best = flat.argmax(axis=1)
                worth = flat[np.arange(nodes), best] > 1e-6
                features.append(np.where(worth, best // BINS, 0))
                bins.append(np.where(worth, best % BINS, BINS))
                node = node * 2 + (binned[np.arange(count), features[-1][node]] > bins[-1][node])
            leaves = 1 << self.depth
            value = -np.bincount(node, gradient, leaves) / (np.bincount(node, weight, leaves) + self.penalty) * self.rate
            margin += value[node]
            self.features.append(np.concatenate(features))
            self.bins.append(np.concatenate(bins))
            self.leaves.append(value)
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class."""
        binned = self._binned(x)
        rows = np.arange(len(x))
        margin = np.full(len(x), self.base)
        for features, bins, leaves in zip(self.features, self.bins, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = node + (1 << level) - 1
                node = node * 2 + (binned[rows, features[at]] > bins[at])
            margin += leaves[node]
        return margin
