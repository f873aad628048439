"""Gradient-boosted regression trees on binned features, and an isotonic calibration, in numpy.

Small on purpose: logistic loss, depth-limited trees, histogram splits.  Fitted on bounded samples only.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, least: float = 4.0, l2: float = 1.0, bins: int = 24):
        self.rounds, self.depth, self.rate, self.least, self.l2, self.bins = rounds, depth, rate, least, l2, bins

    def _binned(self, x):
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Boosted:
        w = np.ones(len(y)) if w is None else w
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)))[1:] if len(x) else np.zeros(0) for j in range(x.shape[1])]
        b = self._binned(x)
        p0 = (np.sum(w * y) + 1) / (np.sum(w) + 2)
        self.base = float(np.log(p0 / (1 - p0)))
        self.trees, f = [], np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), np.maximum(w * p * (1 - p), 1e-9)
            # nodes 0 .. 2^depth - 2 hold (feature, bin); leaves follow
            feat, cut = np.full(2 ** self.depth - 1, -1), np.zeros(2 ** self.depth - 1, int)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                first = 2 ** level - 1
                for k in range(first, 2 ** (level + 1) - 1):
                    here = np.flatnonzero(node == k)
                    gs, hs = g[here].sum(), h[here].sum()
                    best = 1e-6
                    for j in range(x.shape[1]):
                        gb = np.cumsum(np.bincount(b[here, j], g[here], self.bins + 1))
                        hb = np.cumsum(np.bincount(b[here, j], h[here], self.bins + 1))
                        ok = (hb >= self.least / 4) & (hs - hb >= self.least / 4)
                        gain = np.where(ok, gb ** 2 / (hb + self.l2) + (gs - gb) ** 2 / (hs - hb + self.l2) - gs ** 2 / (hs + self.l2), 0)
                        if gain.max(initial=0) > best:
                            best, feat[k], cut[k] = gain.max(), j, int(gain.argmax())
                go = np.where(feat[node] >= 0, b[np.arange(len(y)), feat[node]] > cut[node], False) if len(y) else node
                node = 2 * node + 1 + go
            leaf = node - (2 ** self.depth - 1)
            val = self.rate * np.bincount(leaf, g, 2 ** self.depth) / (np.bincount(leaf, h, 2 ** self.depth) + self.l2)
            self.trees.append((feat, cut, val))
            f += val[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f, at = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feat, cut, val in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + np.where(feat[node] >= 0, b[at, feat[node]] > cut[node], False)
            f += val[node - (2 ** self.depth - 1)]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (left ends of the steps, their probabilities), smoothed by half a count on each side."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order], y[order]):
        if blocks and blocks[-1][0] == s:
            blocks[-1][1] += t
            blocks[-1][2] += 1
        else:
            blocks.append([s, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, t1, n1 = blocks.pop()
            blocks[-1][1] += t1
            blocks[-1][2] += n1
    return np.array([b[0] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
