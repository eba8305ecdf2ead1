"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Trees in arrays: node k of a tree has children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes, -1 where a tree does not split
    limit: np.ndarray  # go left if feature <= limit
    value: np.ndarray  # trees x all nodes
    base: float
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _level in range(self.depth):
                own = feature[node]
                right = (own >= 0) & (x[rows, np.maximum(own, 0)] > limit[node])
                node = 2 * node + 1 + right
            total += value[node]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, least: int = 8) -> Boosted:
    """Boost logistic loss; a tree without a useful split ends early."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1)  # bin b: <= edges[b]
    inner, every = 2 ** depth - 1, 2 ** (depth + 1) - 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(
        np.full((trees, inner), -1), np.zeros((trees, inner)), np.zeros((trees, every)),
        float(np.log(share / (1 - share))), depth,
    )
    score = np.full(n, model.base)
    columns = np.arange(width) * (BINS + 1)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2 ** level - 1
            for k in range(first, 2 * first + 1):
                own = np.flatnonzero(node == k)
                if len(own) >= 2 * least:
                    cells = (binned[own] + columns).ravel()
                    size = width * (BINS + 1)
                    g, h, c = (
                        np.bincount(cells, weights, size).reshape(width, -1).cumsum(axis=1)
                        for weights in (np.repeat(slope[own], width), np.repeat(bend[own], width), None)
                    )
                    gain = g ** 2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    gain[(c < least) | (c[:, -1:] - c < least)] = 0
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > 1e-3:
                        model.feature[t, k], model.limit[t, k] = f, edges[f][b]
                right = (model.feature[t, k] >= 0) & (x[own, max(model.feature[t, k], 0)] > model.limit[t, k])
                node[own] = 2 * k + 1 + right
        g = np.bincount(node, slope, every)
        h = np.bincount(node, bend, every)
        model.value[t] = rate * g / (h + 1)
        score += model.value[t][node]
    return model
