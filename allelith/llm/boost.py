"""Gradient-boosted regression trees for a logistic loss, small enough to fit on the driver and to be written as SQL."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


@dataclass
class Boosted:
    """Margin = bias + sum of trees; probability = sigmoid(slope * margin + shift), fitted on rows the trees did not see."""

    bias: float = 0.0
    trees: list[Node] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))

    def column(self, features: list[Column]) -> Column:
        total = F.lit(self.bias)
        for t in self.trees:
            total = total + _column(t, features)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * F.lit(self.slope) + F.lit(self.shift))))


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None or node.high is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _apply(node.low, x), _apply(node.high, x))


def _column(node: Node, features: list[Column]) -> Column:
    if node.low is None or node.high is None:
        return F.lit(float(node.value))
    return F.when(features[node.feature] <= F.lit(float(node.cut)), _column(node.low, features)).otherwise(_column(node.high, features))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int) -> Node:
    leaf = Node(value=rate * g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, at = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        ends = np.flatnonzero(v[:-1] < v[1:])
        ends = ends[(ends + 1 >= least) & (len(v) - ends - 1 >= least)]
        if len(ends):
            gain = gs[ends] ** 2 / (hs[ends] + 1.0) + (gs[-1] - gs[ends]) ** 2 / (hs[-1] - hs[ends] + 1.0) - whole
            if gain.max() > best:
                k = ends[int(gain.argmax())]
                best, at = float(gain.max()), (f, float((v[k] + v[k + 1]) / 2))
    if at is None:
        return leaf
    low = x[:, at[0]] <= at[1]
    return Node(feature=at[0], cut=at[1], low=_grow(x[low], g[low], h[low], depth - 1, rate, least), high=_grow(x[~low], g[~low], h[~low], depth - 1, rate, least))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 5) -> Boosted:
    """held marks rows kept for calibration. With one class alone the model is that class's rate."""
    x, y, held = np.asarray(x, float), np.asarray(y, float), np.asarray(held, bool)
    if not len(y):
        return Boosted(bias=-5.0)
    xs, ys = (x[~held], y[~held]) if (~held).any() else (x, y)
    mean = (ys.sum() + 0.5) / (len(ys) + 1.0)
    model = Boosted(bias=math.log(mean / (1 - mean)))
    if 0 < ys.sum() < len(ys):
        at = np.full(len(ys), model.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-at))
            tree = _grow(xs, ys - p, p * (1 - p), depth, rate, least)
            model.trees.append(tree)
            at = at + _apply(tree, xs)
    _calibrate(model, x[held], y[held])
    return model


def _calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling by Newton steps, towards smoothed targets."""
    pos = y.sum()
    if not 0 < pos < len(y):
        return
    m, t = model.margin(x), np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w, e = p * (1 - p) + 1e-9, p - t
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(e * m).sum() + 1e-3 * (a - 1), e.sum()])
        a, b = a - step[0], b - step[1]
    if a > 0 and math.isfinite(a) and math.isfinite(b):
        model.slope, model.shift = float(a), float(b)
