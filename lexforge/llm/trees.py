"""Gradient-boosted trees on binned features: a small multi-class learner in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    edges: list[np.ndarray]  # bin edges of each feature
    feature: np.ndarray  # [rounds * classes, 2**depth - 1]
    cut: np.ndarray  # go right if the bin is above
    value: np.ndarray  # [rounds * classes, 2**depth]
    classes: int
    depth: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """[rows, classes] log-probabilities."""
        b, inverse = np.unique(self.bins(x), axis=0, return_inverse=True)  # many nodes look alike
        flat, width = b.reshape(-1), b.shape[1]
        out, row0 = np.zeros((len(b), self.classes)), np.arange(len(b)) * width
        for t in range(len(self.feature)):
            at = np.zeros(len(b), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (flat[row0 + self.feature[t][at]] > self.cut[t][at])
            out[:, t % self.classes] += self.value[t][at - (2**self.depth - 1)]
        out -= out.max(axis=1, keepdims=True)
        out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
        return out[inverse.reshape(-1)]


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 25, depth: int = 4, rate: float = 0.3, l2: float = 1.0, max_bins: int = 64) -> Boosted:
    """Softmax boosting; every tree is complete, split by the largest second-order gain."""
    n, width = x.shape
    edges = []
    for j in range(width):
        u = np.unique(x[:, j])
        edges.append((u[:-1] + u[1:]) / 2 if len(u) <= max_bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])))
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    size = int(b.max()) + 1 if n else 1
    inner = 2**depth - 1
    feature, cut, value = (np.zeros((rounds * classes, k), t) for k, t in ((inner, np.int64), (inner, np.int64), (inner + 1, np.float64)))
    score, target = np.zeros((n, classes)), np.eye(classes)[y]
    for r in range(rounds):
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for k in range(classes):
            g, h = p[:, k] - target[:, k], np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
            t, at = r * classes + k, np.zeros(n, dtype=np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                local = at - first
                best = np.full(count, 1e-9)
                pick_f, pick_c = np.zeros(count, np.int64), np.full(count, size)
                for j in range(width):
                    key = local * size + b[:, j]
                    sg = np.bincount(key, g, count * size).reshape(count, size).cumsum(axis=1)
                    sh = np.bincount(key, h, count * size).reshape(count, size).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                    c = gain.argmax(axis=1)
                    v = gain[np.arange(count), c]
                    up = v > best
                    best[up], pick_f[up], pick_c[up] = v[up], j, c[up]
                feature[t, first : first + count], cut[t, first : first + count] = pick_f, pick_c
                at = 2 * at + 1 + (b[np.arange(n), pick_f[local]] > pick_c[local])
            leaf = at - inner
            value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
            score[:, k] += value[t][leaf]
    return Boosted(edges, feature, cut, value, classes, depth)
