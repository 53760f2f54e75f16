"""Gradient-boosted trees of a fixed depth for a yes or no, in numpy.  Fitted on the driver on a small table."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, equal-frequency bins, complete trees of ``depth`` levels."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(width)]
        used = [f for f, e in enumerate(self.edges) if len(e)]
        # Each cell of (feature, bin) has a number; the cells of all features are summed at once.
        cells = len(used) * self.bins
        cell = np.stack([np.searchsorted(self.edges[f], x[:, f], side="left") + k * self.bins for k, f in enumerate(used)], axis=1) if used else np.zeros((n, 0), int)
        cut = np.arange(self.bins) < np.array([len(self.edges[f]) for f in used], int)[:, None]
        self.base = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
        score = np.full(n, self.base)
        self.features, self.cuts, self.leaves = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            repeated = np.repeat(gradient, len(used)), np.repeat(weight, len(used))
            node = np.zeros(n, int)
            features, cuts = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                wide = 2**level
                key = (cell + node[:, None] * cells).ravel()
                g, h = (np.bincount(key, w, wide * cells).reshape(wide, len(used), self.bins).cumsum(2) for w in repeated)
                gain = g**2 / (h + self.ridge) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + self.ridge) - g[..., -1:] ** 2 / (h[..., -1:] + self.ridge)
                gain = np.where(cut, gain, -np.inf).reshape(wide, -1)
                for k in np.flatnonzero(gain.max(1, initial=-np.inf) > 1e-9):
                    f, at = divmod(int(gain[k].argmax()), self.bins)
                    features[wide - 1 + k], cuts[wide - 1 + k] = used[f], self.edges[used[f]][at]
                inner = wide - 1 + node
                node = 2 * node + (x[np.arange(n), features[inner]] > cuts[inner])
            g, h = np.bincount(node, gradient, 2**self.depth), np.bincount(node, weight, 2**self.depth)
            leaves = self.rate * g / (h + self.ridge)
            score += leaves[node]
            self.features.append(features)
            self.cuts.append(cuts)
            self.leaves.append(leaves)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        x, rows = np.asarray(x, float), np.arange(len(x))
        total = np.full(len(x), self.base)
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                inner = 2**level - 1 + node
                node = 2 * node + (x[rows, features[inner]] > cuts[inner])
            total += leaves[node]
        return total


def platt(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Scale and shift that make log odds calibrated, by Newton steps on held-out rows."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g, w = p - t, p * (1 - p) + 1e-9
        h = np.array([[(w * score * score).sum() + 1e-6, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * score).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
