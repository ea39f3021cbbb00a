"""Gradient-boosted trees over binned features, and isotonic calibration; small, in numpy, on one bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: at node k of a tree, go right if feature[k] > cut[k]."""

    depth: int
    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, ridge: float = 2.0, bins: int = 32, least: int = 5) -> Trees:
    """Newton boosting of the logistic loss over quantile bins."""
    n, width = x.shape
    rate_of = float(np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4))
    model = Trees(depth, float(np.log(rate_of / (1 - rate_of))))
    if n < 2 * least or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            here = node - first
            top = np.zeros(2**level)
            for j in range(width):
                if not len(edges[j]):
                    continue
                cell = here * (bins + 1) + binned[:, j]
                shape = (2**level, bins + 1)
                g = np.bincount(cell, grad, shape[0] * shape[1]).reshape(shape)
                h = np.bincount(cell, curve, shape[0] * shape[1]).reshape(shape)
                c = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape)
                gl, hl, cl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1], c.cumsum(1)[:, :-1]
                gt, ht, ct = g.sum(1, keepdims=True), h.sum(1, keepdims=True), c.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least) | (ct - cl < least)] = 0
                at = gain.argmax(1)
                better = gain[np.arange(shape[0]), at] > top + 1e-9
                top = np.where(better, gain[np.arange(shape[0]), at], top)
                for k in np.flatnonzero(better & (at < len(edges[j]))):
                    feature[first + k], cut[first + k] = j, edges[j][at[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, curve, 2**depth) + ridge)
        score += value[leaf]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(value)
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and the non-decreasing rates at them."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    at, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    pools: list[list[float]] = []  # mean, weight, last place
    for k in range(len(at)):
        pools.append([mean[k], weight[k], k])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, last = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + m * w) / (pools[-1][1] + w), pools[-1][1] + w, last]
    rates = np.empty(len(at))
    start = 0
    for m, w, last in pools:
        # shrunk a little to the middle, so small pools do not claim certainty
        rates[start : last + 1] = (m * w + 0.1) / (w + 0.2)
        start = last + 1
    return at, np.maximum.accumulate(rates)


def calibrated(score: np.ndarray, at: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return np.interp(score, at, rate)
