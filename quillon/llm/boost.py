"""Small gradient-boosted trees (logistic loss) and isotonic calibration, in numpy.

Models are fitted on the driver from a bounded number of rows; they are a few
kilobytes and can be applied to arrays or turned into a SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Trees as flat lists of nodes: (feature, threshold, left, right) or (-1, value, 0, 0).

    A row goes left if its feature is at most the threshold.
    """

    base: float = 0.0
    trees: list[list[tuple[int, float, int, int]]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for nodes in self.trees:
            table = np.array(nodes)
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(len(nodes)):
                f = table[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                left = x[rows, np.maximum(f, 0)] <= table[at, 1]
                at = np.where(inner, np.where(left, table[at, 2], table[at, 3]).astype(np.int64), at)
            total += table[at, 1]
        return total

    def sql(self, features: list[str]) -> str:
        """The raw score as a SQL expression over the named features."""

        def node(nodes: list, k: int) -> str:
            f, v, left, right = nodes[k]
            return f"{v!r}D" if f < 0 else f"if({features[f]} <= {v!r}D, {node(nodes, left)}, {node(nodes, right)})"

        return " + ".join([f"{self.base!r}D", *[node(t, 0) for t in self.trees]])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 8, ridge: float = 1.0) -> Trees:
    """Newton boosting on quantile bins.  Without both labels the base rate is all."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    if not len(y):
        return Trees(base=0.0)
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(base=float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        nodes: list[tuple[int, float, int, int]] = []
        step = np.zeros(len(y))

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-9, -1, -1)
            if level < depth and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = codes[rows, f]
                    gl = np.bincount(k, g[rows], len(c) + 1).cumsum()[:-1]
                    hl = np.bincount(k, h[rows], len(c) + 1).cumsum()[:-1]
                    nl = np.bincount(k, minlength=len(c) + 1).cumsum()[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    if gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
            if best[1] < 0:
                value = float(rate * gs / (hs + ridge))
                nodes.append((-1, value, 0, 0))
                step[rows] = value
                return at
            _, f, k = best
            nodes.append((f, float(cuts[f][k]), 0, 0))
            left = codes[rows, f] <= k
            a, b = grow(rows[left], level + 1), grow(rows[~left], level + 1)
            nodes[at] = (f, float(cuts[f][k]), a, b)
            return at

        grow(np.arange(len(y)), 0)
        model.trees.append(nodes)
        score += step
    return model


@dataclass
class Isotonic:
    """A rising function from raw scores to probabilities, linear between its knots."""

    x: list[float] = field(default_factory=lambda: [0.0])
    y: list[float] = field(default_factory=lambda: [0.5])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators.

    Each block counts half a row of either label besides its own, so that no
    score is certain.
    """
    if not len(raw):
        return Isotonic()
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, label in zip(np.asarray(raw, float)[order], np.asarray(y, float)[order], strict=True):
        blocks.append([label, 1.0, r, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    xs, ys = [], []
    for s, n, lo, hi in blocks:
        value = (s + 0.5) / (n + 1)
        value = max(value, ys[-1]) if ys else value
        for at in ([lo, hi] if hi > lo else [lo]):
            xs.append(float(at))
            ys.append(float(value))
    return Isotonic(xs, ys)
