"""Gradient-boosted trees for two classes on few features, on numpy alone."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth on binned features; log odds are the sum of the leaves."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.2, bins: int = 24, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge = depth, rounds, rate, bins, ridge
        self.start, self.feature, self.cut, self.leaf = 0.0, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(d)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.rounds, inner), int)
        self.cut = np.full((self.rounds, inner), np.inf)
        self.leaf = np.zeros((self.rounds, inner + 1))
        score = np.full(n, self.start)
        width = self.bins + 1
        flat = binned + np.arange(d) * width
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, int)
            for k in range(inner):
                at = np.flatnonzero(node == k)
                if len(at) > 1:
                    cells = flat[at].ravel()
                    sg = np.bincount(cells, np.repeat(g[at], d), d * width).reshape(d, width).cumsum(1)[:, :-1]
                    sh = np.bincount(cells, np.repeat(h[at], d), d * width).reshape(d, width).cumsum(1)[:, :-1]
                    g_all, h_all = g[at].sum(), h[at].sum()
                    gain = sg**2 / (sh + self.ridge) + (g_all - sg) ** 2 / (h_all - sh + self.ridge) - g_all**2 / (h_all + self.ridge)
                    j, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(cuts[j]):
                        self.feature[t, k], self.cut[t, k] = j, cuts[j][b]
                node[at] = 2 * k + 1 + (x[at, self.feature[t, k]] > self.cut[t, k])
            leaf = node - inner
            self.leaf[t] = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
            score += self.leaf[t][leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(cut)]
        return out


def calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of labels over scores."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * score * score).sum() + 1e-3, (q * score).sum()], [(q * score).sum(), q.sum() + 1e-3]])
        d = np.linalg.solve(h, [((y - p) * score).sum() - 1e-3 * (a - 1), (y - p).sum() - 1e-3 * b])
        a, b = a + d[0], b + d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(b)
