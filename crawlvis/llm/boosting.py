"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Trees of equal depth, each in arrays: node k has children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees by inner nodes
    limit: np.ndarray  # a row goes right if its feature is above
    leaf: np.ndarray  # trees by leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while len(at) and at[0] < inner:  # all leaves lie at one depth
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += leaf[at - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 4, rate: float = 0.25, penalty: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss. The result depends on the rows alone."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n, width = binned.shape
    inner, leaves = 2**depth - 1, 2**depth
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score, flat = np.full(n, base), binned + np.arange(width) * BINS
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, limit, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            cells = flat[rows].ravel()
            sums = [np.bincount(cells, weights=np.repeat(v[rows], width), minlength=width * BINS).reshape(width, BINS) for v in (g, h)]
            left_g, left_h = (np.cumsum(s, axis=1)[:, :-1] for s in sums)
            all_g, all_h = g[rows].sum(), h[rows].sum()
            gain = left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g**2 / (all_h + penalty)
            gain[(left_h < 1e-2) | (all_h - left_h < 1e-2)] = 0
            f, cut = np.unravel_index(gain.argmax(), gain.shape)
            right = np.zeros(len(rows), dtype=bool)
            if gain[f, cut] > 1e-6 and cut < len(edges[f]):
                feature[node], limit[node] = f, edges[f][cut]
                right = binned[rows, f] > cut
            at[rows] = 2 * node + 1 + right
        place = at - inner
        leaf = -rate * np.bincount(place, weights=g, minlength=leaves) / (np.bincount(place, weights=h, minlength=leaves) + penalty)
        score += leaf[place]
        trees.append((feature, limit, leaf))
    return Forest(*(np.stack(t) for t in zip(*trees, strict=True)), base)
