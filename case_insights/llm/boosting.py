"""Gradient-boosted trees for two classes, on binned features. Small: for training sets that fit in a task."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Logistic boosting of trees of fixed depth, kept as arrays: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, base: float = 0.0, depth: int = 4, trees: list[tuple[list, list, list]] | None = None):
        self.base, self.depth, self.trees = base, depth, trees or []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, rate: float = 0.2):
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        raw = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = weight * (y - p), weight * p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = [-1] * size, [0.0] * size, [0.0] * size
            at = np.zeros(len(y), np.int64)
            for node in range(size):
                rows = np.flatnonzero(at == node)
                g, h = grad[rows].sum(), hess[rows].sum()
                value[node] = float(rate * g / (h + 1.0))
                if node >= 2**self.depth - 1 or len(rows) < 10:
                    continue
                best = (1e-6, -1, 0)
                for f, e in enumerate(edges):
                    gs = np.bincount(binned[rows, f], grad[rows], len(e) + 1).cumsum()[:-1]
                    hs = np.bincount(binned[rows, f], hess[rows], len(e) + 1).cumsum()[:-1]
                    if len(gs):
                        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                        k = int(gain.argmax())
                        best = max(best, (float(gain[k]), f, k))
                if best[1] >= 0:
                    _, f, k = best
                    feature[node], cut[node] = f, float(edges[f][k])
                    at[rows] = np.where(binned[rows, f] <= k, 2 * node + 1, 2 * node + 2)
            raw += np.array(value)[at]
            self.trees.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            feature, cut, value = np.array(feature), np.array(cut), np.array(value)
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += value[at]
        return total
