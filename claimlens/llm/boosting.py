"""Gradient-boosted trees for a yes-or-no label, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees of one depth as arrays: node k of a tree has children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right where the feature is above
    value: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row of x."""
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while (node < inner).all() if len(node) else False:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner] if len(node) else 0
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss; deterministic."""
    n, many = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(many)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(many)])
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(n, base)
    inner = (1 << depth) - 1
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            local = node - first
            best = np.zeros(count)
            for j in range(many):
                width = len(cuts[j]) + 1
                if width < 2:
                    continue
                key = local * width + binned[j]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga**2 / (ha + penalty)
                gain[(hl < least) | (ha - hl < least)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                won = top > best + 1e-9
                best[won] = top[won]
                feature[t, first : first + count][won] = j
                cut[t, first : first + count][won] = cuts[j][at[won]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > cut[t][node])
        leaf = node - inner
        g_leaf, h_leaf = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = -rate * g_leaf / (h_leaf + penalty)
        margin += value[t][leaf]
    return Forest(feature, cut, value, base)
