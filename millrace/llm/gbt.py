"""Gradient-boosted trees with monotonic constraints, trained on a bounded sample, scored from flat numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees one after the other. A node that is its own child is a leaf; missing values go left."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """All rows walk all trees at once, one level a step."""
        at = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        row = np.arange(len(x))[:, None]
        while True:
            goes_right = x[row, self.feature[at]] > self.threshold[at]
            below = np.where(goes_right, self.right[at], self.left[at])
            if (below == at).all():
                break
            at = below
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 5, l2: float = 1.0
) -> Forest:
    """Logistic loss, second-order gains over up to 64 quantile bins for each feature.

    monotone: +1, 0 or -1 for each feature: the score never falls, is free, or never rises as the feature grows. A
    split that breaks its sign is not taken, and the values below it are kept on their sides of its middle.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T] if len(x) else [np.empty(0)] * x.shape[1]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1) if len(x) else x.astype(int)
    rate0 = (y.sum() + 1) / (len(y) + 2)
    both = len(set(y.tolist())) == 2
    base = float(np.log(rate0 / (1 - rate0))) if both else 0.0  # one class teaches nothing
    score = np.full(len(x), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        weight = lambda gs, hs: np.clip(-gs / (hs + l2), low, high)
        nodes.append([0, np.inf, me, me, rate * float(weight(g[rows].sum(), h[rows].sum()))])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            gain_of = lambda gs, hs, w: -(gs * w + 0.5 * (hs + l2) * w * w)
            g_all, h_all = g[rows].sum(), h[rows].sum()
            whole = gain_of(g_all, h_all, weight(g_all, h_all))
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(cut) + 1))[:-1] for w in (g[rows], h[rows], None))
                wl, wr = weight(gl, hl), weight(g_all - gl, h_all - hl)
                gain = gain_of(gl, hl, wl) + gain_of(g_all - gl, h_all - hl, wr) - whole
                ok = (nl >= least) & (len(rows) - nl >= least) & (monotone[f] * (wr - wl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, wl[k], wr[k]))
        if best[1]:
            f, k, wl, wr = best[1]
            middle, sign = (wl + wr) / 2, monotone[f]
            goes_left = binned[rows, f] <= k
            l_low, l_high = (middle if sign < 0 else low), (middle if sign > 0 else high)
            r_low, r_high = (middle if sign > 0 else low), (middle if sign < 0 else high)
            left = grow(rows[goes_left], g, h, level + 1, l_low, l_high)
            right = grow(rows[~goes_left], g, h, level + 1, r_low, r_high)
            nodes[me][:4] = [f, cuts[f][k], left, right]
        return me

    for _ in range(trees if both else 0):
        p = 1 / (1 + np.exp(-score))
        start = len(nodes)
        roots.append(grow(np.arange(len(x)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        part = np.array(nodes[start:])
        at = np.zeros(len(x), int)
        for _ in range(depth):
            below = np.where(x[np.arange(len(x)), part[at, 0].astype(int)] > part[at, 1], part[at, 3], part[at, 2])
            at = below.astype(int) - start
        score += part[at, 4]
    flat = np.array(nodes).reshape(-1, 5)
    return Forest(
        np.array(roots, int), flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], base
    )
