"""Gradient-boosted trees: fitted in numpy on a bounded sample, walked in Spark SQL."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """Logistic boosting of small regression trees with a Platt calibration."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    least: int = 5
    base: float = 0.0
    grown: list = field(default_factory=list)
    calibration: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, margin = float(np.log(share / (1 - share))), np.full(len(y), np.log(share / (1 - share)))
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.grown.append(tree)
            margin = margin + _leaf(tree, x)
        return self

    def _grow(self, x, gradient, weight, rows, depth):
        g, h = gradient[rows].sum(), weight[rows].sum()
        best = (1e-6, None, None)
        for k in range(x.shape[1] if depth else 0):
            order = rows[np.argsort(x[rows, k], kind="stable")]
            values = x[order, k]
            gl, hl = np.cumsum(gradient[order]), np.cumsum(weight[order])
            ends = np.flatnonzero(np.diff(values) > 0)
            ends = ends[(ends + 1 >= self.least) & (len(rows) - ends - 1 >= self.least)]
            if len(ends):
                gain = gl[ends] ** 2 / (hl[ends] + 1) + (g - gl[ends]) ** 2 / (h - hl[ends] + 1) - g**2 / (h + 1)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], k, float((values[ends[at]] + values[ends[at] + 1]) / 2))
        if best[1] is None:
            return float(self.rate * g / (h + 1))
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, gradient, weight, rows[low], depth - 1), self._grow(x, gradient, weight, rows[~low], depth - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(_leaf(tree, x) for tree in self.grown)

    def calibrate(self, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> Boosted:
        """Platt scaling on rows that the trees have not seen, by Newton steps."""
        z = np.stack([self.margin(x), np.ones(len(y))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z @ w))
            w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (y - p) - 1e-2 * (w - [1, 0]))
        self.calibration = (float(w[0]), float(w[1]))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-(a * self.margin(x) + b)))

    def columns(self, name: str) -> dict[str, Column]:
        """The trees as constant columns ``<name>_...``, each as one JSON array that Spark
        reads when it plans: feature, cut and value by tree and place, where a place's
        children have twice its number (and one more), from 1 on. A leaf above the last level
        goes on below itself."""
        inner, leaves = 1 << self.depth, 1 << self.depth
        feature, cut, value = np.zeros((len(self.grown), inner), int), np.zeros((len(self.grown), inner)), np.zeros((len(self.grown), leaves))

        def lay(t: int, node, place: int) -> None:
            if place >= inner:
                value[t, place - inner] = node
                return
            k, at, low, high = node if isinstance(node, tuple) else (0, 0.0, node, node)
            feature[t, place], cut[t, place] = k, at
            lay(t, low, 2 * place)
            lay(t, high, 2 * place + 1)

        for t, tree in enumerate(self.grown):
            lay(t, tree, 1)
        a, b = self.calibration
        constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<{kind}>")
        return {
            f"{name}_feature": constant(feature.ravel().tolist(), "int"), f"{name}_cut": constant(cut.ravel().tolist(), "double"), f"{name}_value": constant(value.ravel().tolist(), "double"),
            f"{name}_size": constant([len(self.grown), self.depth, inner], "int"), f"{name}_scale": constant([self.base, a, b], "double"),
        }

    @staticmethod
    def walk(x: str, name: str) -> str:
        """SQL of the calibrated probability of the features in the array ``x``, by the columns
        that :meth:`columns` gives."""
        of = lambda part, i: f"get({name}_{part}, {i})"
        at = f"i * {of('size', 2)}"
        leaf = f"aggregate(sequence(1, {of('size', 1)}), 1, (n, d) -> 2 * n + if(get({x}, {of('feature', f'{at} + n')}) <= {of('cut', f'{at} + n')}, 0, 1))"
        total = f"aggregate(sequence(0, {of('size', 0)} - 1), {of('scale', 0)}, (t, i) -> t + {of('value', f'{at} + {leaf} - {of("size", 2)}')})"
        return f"(1 / (1 + exp(-({of('scale', 1)} * ({total}) + {of('scale', 2)}))))"


def _leaf(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    k, cut, low, high = node
    return np.where(x[:, k] <= cut, _leaf(low, x), _leaf(high, x))
