"""Gradient-boosted trees on binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees as flat arrays: feature, threshold, left child and leaf value of each node."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = left[at] >= 0
                if not inner.any():
                    break
                f = feature[at]
                step = left[at] + (x[rows, np.maximum(f, 0)] > threshold[at])
                at = np.where(inner, step, at)
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: the isotonic step function of the margin, interpolated between its knots."""
        m = self.margin(x)
        if not len(self.knots):
            return 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        return np.interp(m, self.knots, self.levels)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss with histogram splits."""
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    model = Boosted(float(np.log(mean / (1 - mean))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    # Rare positive values of sparse features would vanish among the zero quantiles.
    cuts = [np.unique(np.concatenate([c, np.quantile(v[v > 0], np.linspace(0, 0.9, 8)) * (1 - 1e-9)])) if (v > 0).any() else c for c, v in zip(cuts, x.T, strict=True)]
    code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    width = max(len(c) for c in cuts) + 1
    m = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, left, value = [-1], [0.0], [-1], [0.0]
        at = np.zeros(len(y), np.int64)
        frontier = [0]
        for level in range(depth + 1):
            grown = []
            for node in frontier:
                rows = np.flatnonzero(at == node)
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -rate * gs / (hs + l2)
                if level == depth or len(rows) < 4:
                    continue
                best = (1e-6, -1, 0)
                for f in range(x.shape[1]):
                    gl = np.cumsum(np.bincount(code[rows, f], g[rows], width))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, f], h[rows], width))[:-1]
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(hl < least * 0.1) | (hs - hl < least * 0.1)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0] and k < len(cuts[f]):
                        best = (float(gain[k]), f, k)
                if best[1] >= 0:
                    _, f, k = best
                    feature[node], threshold[node], left[node] = f, float(cuts[f][k]), len(feature)
                    for _side in range(2):
                        feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
                    at[rows] = left[node] + (x[rows, f] > threshold[node])
                    grown += [left[node], left[node] + 1]
            frontier = grown
        value = np.array(value)
        model.trees.append((np.array(feature), np.array(threshold), np.array(left), value))
        m += value[at]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing levels for interpolation.

    Each pooled block is shrunk by half a count towards 1/2, so that no level is exactly 0 or 1.
    """
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(m), float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    levels = np.repeat([(b[0] + 0.5 * min(1.0, b[1] / 50)) / (b[1] + min(1.0, b[1] / 50)) for b in blocks], 2)
    return knots, np.maximum.accumulate(levels)
