"""Gradient-boosted trees on a bounded sample, in numpy, and the calibration of their scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, BINS, L2 = 40, 3, 0.3, 32, 1.0


@dataclass
class Trees:
    """Complete trees of DEPTH levels: each inner node asks whether a feature is at most a bound."""

    start: float
    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(x), np.intp)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[row, feature[at]] > bound[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Trees for the logistic loss. Splits are sought over BINS quantiles of each feature; equal gains go to
    the first feature and lowest bound, so that the same rows in the same order give the same trees."""
    bounds = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)], axis=1)
    rate = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    score = np.full(len(y), start := float(np.log(rate / (1 - rate))))
    features, limits, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, limit, at = np.zeros(2**DEPTH - 1, np.intp), np.full(2**DEPTH - 1, np.inf), np.zeros(len(y), np.intp)
        for node in range(2**DEPTH - 1):
            rows = np.flatnonzero(at == node)
            best = (1e-9, 0, np.inf)
            for f, b in enumerate(bounds):
                if len(b) and len(rows):
                    n = len(b) + 1
                    left_g, left_h = (np.cumsum(np.bincount(binned[rows, f], v[rows], n))[:-1] for v in (g, h))
                    all_g, all_h = g[rows].sum(), h[rows].sum()
                    gain = left_g**2 / (left_h + L2) + (all_g - left_g) ** 2 / (all_h - left_h + L2) - all_g**2 / (all_h + L2)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float(b[k]))
            feature[node], limit[node] = best[1:]
            at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        low = 2**DEPTH - 1
        leaf = RATE * np.bincount(at - low, g, 2**DEPTH) / (np.bincount(at - low, h, 2**DEPTH) + L2)
        score += leaf[at - low]
        features.append(feature), limits.append(limit), leaves.append(leaf)
    return Trees(start, np.stack(features), np.stack(limits), np.stack(leaves))


@dataclass
class Steps:
    """An increasing step function from scores to rates."""

    at: np.ndarray
    rate: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.at, score, side="right") - 1
        return np.where(k < 0, 0.0, self.rate[np.maximum(k, 0)])


def calibrated(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Steps:
    """Isotonic regression of held-out labels on scores. Each block counts one more row that is not
    positive, so that a few rows do not look certain."""
    blocks: list[list[float]] = []
    for s in np.unique(score):
        here = score == s
        blocks.append([float(s), float((weight * y)[here].sum()), float(weight[here].sum())])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, a, b = blocks.pop()
            blocks[-1][1] += a
            blocks[-1][2] += b
    if not blocks:
        return Steps(np.zeros(0), np.zeros(1))
    return Steps(np.array([b[0] for b in blocks]), np.array([b[1] / (b[2] + 1) for b in blocks]))
