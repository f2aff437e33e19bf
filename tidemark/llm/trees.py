"""Gradient-boosted trees in numpy: trained on the driver from a bounded sample, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Flat nodes: a node with feature -1 is a leaf; rows with x <= threshold go left. roots starts each tree."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all rows go down all trees at once."""
        if not len(x) or not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    def sql(self, names: list[str]) -> str:
        """The log-odds as nested CASE expressions over columns of these names."""

        def node(i: int) -> str:
            if self.feature[i] < 0:
                return f"{float(self.value[i])!r}D"
            return f"CASE WHEN {names[self.feature[i]]} <= {float(self.threshold[i])!r}D THEN {node(self.left[i])} ELSE {node(self.right[i])} END"

        return " + ".join([f"{float(self.base)!r}D", *(f"({node(int(r))})" for r in self.roots)])


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 5, l2: float = 1.0) -> Trees:
    """Logistic boosting on histograms. monotone[f] = 1 (-1): the score must not fall (rise) as feature f grows.

    A split that would break a constraint is not taken, and the middle of a constrained split bounds the leaves on either
    side, so the whole score is monotone. One class only, or no rows: no trees, only the prior.
    """
    monotone = monotone or {}
    n, d = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n == 0 or y.min() == y.max():
        n_trees = 0
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf")) if n else np.zeros(0) for f in range(d)]
    codes = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(d)], 1) if n else np.zeros((0, d), int)
    score = np.full(n, base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        own = leaf(g, h, low, high)
        nodes.append([-1, 0.0, at, at, rate * own])
        best = (1e-6, -1, 0)
        if level < depth and len(rows) >= 2 * least:
            for f in range(d):
                k = len(cuts[f]) + 1
                if k < 2:
                    continue
                c = codes[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, k))[:-1] for w in (grad[rows], hess[rows], None))
                gr, hr, nr = g - gl, h - hl, len(rows) - nl
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                cost = lambda gg, hh, v: gg * v + 0.5 * (hh + l2) * v * v
                gain = cost(g, h, own) - cost(gl, hl, vl) - cost(gr, hr, vr)
                ok = (nl >= least) & (nr >= least)
                if f in monotone:
                    ok &= monotone[f] * (vr - vl) >= 0
                gain = np.where(ok, gain, -1.0)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), f, b, float(vl[b]), float(vr[b]))
        if best[1] >= 0:
            _, f, b, vl, vr = best
            go = codes[rows, f] <= b
            bounds = [(low, high), (low, high)]
            if f in monotone:
                mid = (vl + vr) / 2
                bounds = [(low, mid), (mid, high)] if monotone[f] > 0 else [(mid, high), (low, mid)]
            left = grow(rows[go], grad, hess, level + 1, *bounds[0])
            right = grow(rows[~go], grad, hess, level + 1, *bounds[1])
            nodes[at] = [f, float(cuts[f][b]), left, right, 0.0]
        else:
            score[rows] += rate * own
        return at

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-9), 0, -np.inf, np.inf))
    table = np.array(nodes, float).reshape(-1, 5)
    return Trees(base, table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, int), depth)
