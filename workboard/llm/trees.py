"""Small boosted trees over a bounded training table, for compiling into column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None   # x <= threshold
    high: Node | None = None  # x > threshold


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds halfway between neighbouring quantiles of the distinct values."""
    v = np.unique(x)
    if len(v) > bins:
        v = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)))
    return (v[:-1] + v[1:]) / 2


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 30, depth: int = 3,
          rate: float = 0.3, share: float = 1.0, bins: int = 32, least: float = 5.0, seed: int = 7) -> tuple:
    """Newton boosting of the logistic loss: (base score, trees). ``share`` of the rows is drawn for each tree."""
    w = np.ones(len(y)) if weight is None else weight.astype(float)
    cuts = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    b = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    mean = (np.dot(w, y) + 0.5) / (w.sum() + 1)
    base = float(np.log(mean / (1 - mean)))
    margin, trees, rng = np.full(len(y), base), [], np.random.default_rng(seed)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Node:
        gs, hs = g[rows].sum(), h[rows].sum()
        node, best = Node(rate * gs / (hs + 1.0)), 1e-3
        if not left:
            return node
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(b[rows, f], g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b[rows, f], h[rows], len(c) + 1))[:-1]
            wl = np.cumsum(np.bincount(b[rows, f], w[rows], len(c) + 1))[:-1]
            gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
            gain[(wl < least) | (w[rows].sum() - wl < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, node.feature, node.threshold = gain[k], f, float(c[k])
                split = k
        if node.feature >= 0:
            side = b[rows, node.feature] <= split
            node.low, node.high = grow(rows[side], g, h, left - 1), grow(rows[~side], g, h, left - 1)
        return node

    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        rows = np.arange(len(y)) if share >= 1 else np.flatnonzero(rng.random(len(y)) < share)
        tree = grow(rows, w * (y - p), w * p * (1 - p), depth)
        trees.append(tree)
        margin = margin + predict(tree, x)
    return base, trees


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.threshold, predict(node.low, x), predict(node.high, x))


def column(node: Node, features: list[Column]) -> Column:
    """The tree as nested CASE expressions."""
    if node.feature < 0:
        return F.lit(float(node.value))
    return (F.when(features[node.feature] <= F.lit(node.threshold), column(node.low, features))
            .otherwise(column(node.high, features)))


def paths(node: Node, so_far: tuple = ()) -> list[tuple]:
    """Every path from the root to a node below it, as a tuple of (feature, is_low, threshold)."""
    out = [so_far] if so_far else []
    if node.feature >= 0:
        out += paths(node.low, (*so_far, (node.feature, True, node.threshold)))
        out += paths(node.high, (*so_far, (node.feature, False, node.threshold)))
    return out
