"""Gradient-boosted trees for two classes, on histograms of binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: per inner node a feature and a threshold (values above it go right), per leaf a value."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(len(value).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; every split is the best over all features and bins of its node."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    spot = binned + np.arange(m) * bins
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    score = np.full(n, np.log(share / (1 - share)))
    start = float(score[0])
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            k = 1 << level
            flat = (node[:, None] * (m * bins) + spot).ravel()
            gs = np.bincount(flat, np.repeat(g, m), k * m * bins).reshape(k, m, bins).cumsum(2)
            hs = np.bincount(flat, np.repeat(h, m), k * m * bins).reshape(k, m, bins).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            best = gain.reshape(k, -1).argmax(1)
            j, b = best // bins, best % bins
            right = np.zeros(n, bool)
            for i in range(k):
                if gain[i, j[i], b[i]] > 1e-9 and b[i] < len(cuts[j[i]]):
                    feature[k - 1 + i], threshold[k - 1 + i] = j[i], cuts[j[i]][b[i]]
                    here = node == i
                    right[here] = binned[here, j[i]] > b[i]
            node = 2 * node + right
        leaves = 1 << depth
        value = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
        score += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(start, np.array(features), np.array(thresholds), np.array(values))
