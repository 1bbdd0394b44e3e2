"""Gradient-boosted trees for a yes/no label, by histograms, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees of one depth as arrays: split feature, threshold and leaf value by position."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of yes for each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while node[0] < len(feature) if len(x) else False:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 50, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Fit the log-odds of y by Newton steps; every split is the best over all features' histograms."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    f = np.full(n, base)
    inner = (1 << depth) - 1
    all_features, all_thresholds, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(width, 1e-9)
            where = np.full((width, 2), -1)
            for j in range(d):
                if not len(cuts[j]):
                    continue
                k = len(cuts[j]) + 1
                key = local * k + binned[:, j]
                gs = np.bincount(key, g, width * k).reshape(width, k)
                hs = np.bincount(key, h, width * k).reshape(width, k)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                where[better] = np.stack([np.full(width, j), top], axis=1)[better]
            for i, (j, b) in enumerate(where):
                if j >= 0:
                    feature[first + i], threshold[first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        f += value[leaf]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_leaves.append(value)
    return Boosted(np.array(all_features), np.array(all_thresholds), np.array(all_leaves), base)
