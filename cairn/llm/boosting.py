"""Small gradient-boosted regression trees on a bounded table, and their form as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int) -> Leaf | Split:
    total_g, total_h = g.sum(), h.sum()
    leaf = Leaf(float(total_g / (total_h + 1.0)))
    if not depth or len(x) < 2 * least:
        return leaf
    best, base = (1e-6, 0, 0.0), total_g**2 / (total_h + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        gain = cg**2 / (ch + 1.0) + (total_g - cg) ** 2 / (total_h - ch + 1.0) - base
        gain[(v[1:] <= v[:-1]) | (np.arange(1, len(v)) < least) | (np.arange(1, len(v)) > len(v) - least)] = -1
        k = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[k] > best[0]:
            best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[0] <= 1e-6:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], _grow(x[low], g[low], h[low], depth - 1, least), _grow(x[~low], g[~low], h[~low], depth - 1, least))


def _value(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at, _value(tree.low, x), _value(tree.high, x))


def _column(tree: Leaf | Split, features: list[Column]) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(features[tree.feature] <= tree.at, _column(tree.low, features)).otherwise(_column(tree.high, features))


class Boosted:
    """Logistic boosting; margins are calibrated to probabilities on rows that no tree has seen."""

    def __init__(self, trees: list, rate: float, a: float, b: float):
        self.trees, self.rate, self.a, self.b = trees, rate, a, b

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum((_value(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30)))

    def probability_column(self, features: list[Column]) -> Column:
        total = F.lit(0.0)
        for t in self.trees:
            total = total + _column(t, features)
        return 1 / (1 + F.exp(-(total * (self.rate * self.a) + self.b)))


def held(n: int) -> np.ndarray:
    """The rows that calibrate and grow no tree: every third."""
    return np.arange(n) % 3 == 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 10) -> Boosted:
    """Every third row calibrates, the others grow trees."""
    unseen = held(len(x))
    grown, margin = [], np.zeros(int((~unseen).sum()))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        t = _grow(x[~unseen], y[~unseen] - p, p * (1 - p), depth, least)
        grown.append(t)
        margin += rate * _value(t, x[~unseen])
    model = Boosted(grown, rate, 1.0, 0.0)
    m, t = model.margin(x[unseen]), y[unseen]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of logistic calibration, with a weak prior on the identity
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + (a - 1), (p - t).sum() + b])
        w = p * (1 - p)
        curve = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
        a, b = np.array([a, b]) - np.linalg.solve(curve, g)
    model.a, model.b = float(max(a, 0.1)), float(b)
    return model
