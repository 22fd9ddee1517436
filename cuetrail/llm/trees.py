"""Gradient-boosted trees on binned columns, with monotonic constraints, flattened into numpy node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in one set of arrays; a leaf points to itself on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 5.0, least: int = 20) -> Forest:
    """monotone: -1, 0 or 1 for each column, the direction in which the score may go as the column grows.

    A split that would break a constraint is not taken, and the children's values stay on their side of the split's middle.
    """
    n, k = x.shape
    y = y.astype(np.float64)
    mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], axis=1) if n else np.zeros((0, k), dtype=int)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    margin = np.full(n, base)
    flat = binned + np.arange(k) * bins
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        work = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while work:
            node, rows, low, high, level = work.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value = float(np.clip(gs / (hs + ridge), low, high))
            nodes[node][4] = rate * value
            best, chosen = 1e-3, None
            if level < depth and len(rows) >= 2 * least:
                where = flat[rows].ravel()
                sums = [np.cumsum(np.bincount(where, np.repeat(v, k) if v is not None else None, minlength=k * bins).reshape(k, bins), axis=1) for v in (g[rows], h[rows], None)]
                gl, hl, nl = sums
                wl, wr = np.clip(gl / (hl + ridge), low, high), np.clip((gs - gl) / (hs - hl + ridge), low, high)
                gain = gl * wl - 0.5 * (hl + ridge) * wl**2 + (gs - gl) * wr - 0.5 * (hs - hl + ridge) * wr**2 - (gs * value - 0.5 * (hs + ridge) * value**2)
                ok = (nl >= least) & (len(rows) - nl >= least) & (monotone[:, None] * (wr - wl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > best and b < len(cuts[j]):
                    chosen = j, b, wl[j, b], wr[j, b]
            if chosen is None:
                margin[rows] += rate * value
                continue
            j, b, vl, vr = chosen
            goes = binned[rows, j] <= b
            middle = (vl + vr) / 2
            first = len(nodes)
            nodes[node][:4] = [j, cuts[j][b], first, first + 1]
            nodes += [[0, np.inf, first, first, 0.0], [0, np.inf, first + 1, first + 1, 0.0]]
            ll, lh, rl, rh = low, high, low, high
            if monotone[j] > 0:
                lh, rl = middle, middle
            elif monotone[j] < 0:
                ll, rh = middle, middle
            work += [(first, rows[goes], ll, lh, level + 1), (first + 1, rows[~goes], rl, rh, level + 1)]
    a = np.array(nodes if nodes else np.zeros((0, 5)))
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots, dtype=int), depth, base)
