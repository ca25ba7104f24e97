"""Gradient-boosted trees on binned features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Trees of one depth in arrays: node i has the children 2i+1 and 2i+2; the last level holds the leaves' values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (len(leaf) - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, least: float = 1.0) -> Trees:
    """Logistic loss, second-order splits over quantile bins, `least` as the leaves' ridge. Ties go to the first feature and cut."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    features, values, outs = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            chosen = np.full(width, BINS, np.int64)
            for f in range(x.shape[1]):
                key = at * BINS + binned[:, f]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gain = gs**2 / (hs + least) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + least) - gs[:, -1:] ** 2 / (hs[:, -1:] + least)
                gain[:, len(cuts[f]) :] = 0
                cut = gain.argmax(axis=1)
                value = gain[np.arange(width), cut]
                for w in np.flatnonzero(value > best):
                    best[w], chosen[w] = value[w], cut[w]
                    features[t, first + w], values[t, first + w] = f, cuts[f][cut[w]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), features[t, node]] > chosen[at])
        leaf = node - inner
        outs[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + least)
        margin += outs[t][leaf]
    return Trees(features, values, outs, base)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of the least squares, by pooling neighbours that fall: each step's ends and, twice, its mean.

    Each mean is smoothed by one row of the overall share, so that no step says 0 or 1.
    """
    order = np.argsort(score, kind="stable")
    prior = (y.sum() + 1) / (len(y) + 2)
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][0] == s:
            blocks[-1][1] += v
            blocks[-1][2] += 1
        else:
            blocks.append([s, v, 1, s])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, v2, n2, high = blocks.pop()
            blocks[-1][1] += v2
            blocks[-1][2] += n2
            blocks[-1][3] = high
    ends = np.array([(b[0], b[3]) for b in blocks]).reshape(-1)
    return ends, np.repeat(np.maximum.accumulate([(b[1] + prior) / (b[2] + 1) for b in blocks]), 2)


def calibrated(score: np.ndarray, ends: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The calibrated values: a step's mean inside it, linear between steps."""
    return np.interp(score, ends, mean)
