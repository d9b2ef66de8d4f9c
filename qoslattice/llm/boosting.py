"""Gradient boosted trees over counted feature combinations.

The features have few levels each, so a corpus of any size comes down to a table
of combinations with their counts. That table is exact for boosting: no row is
sampled, and its size is bounded by the product of the levels. Trees are
returned as Spark expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, DEPTH, RATE, SMOOTH = 20, 3, 0.4, 1.0


@dataclass(frozen=True)
class Node:
    """A leaf has no feature; rows with the feature at or below ``at`` go to ``low``."""

    value: float = 0.0
    feature: str | None = None
    at: int = 0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, names: list[str], gradient: np.ndarray, weight: np.ndarray, depth: int) -> Node:
    g, h = gradient.sum(), weight.sum()
    leaf = Node(RATE * g / (h + SMOOTH))
    if depth == 0 or len(x) < 2:
        return leaf
    best, found = 1e-9, None
    for j in range(x.shape[1]):
        for at in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= at
            gl, hl = gradient[low].sum(), weight[low].sum()
            gain = gl**2 / (hl + SMOOTH) + (g - gl) ** 2 / (h - hl + SMOOTH) - g**2 / (h + SMOOTH)
            if gain > best:
                best, found = gain, (j, at, low)
    if found is None:
        return leaf
    j, at, low = found
    return Node(
        0.0, names[j], int(at),
        _grow(x[low], names, gradient[low], weight[low], depth - 1),
        _grow(x[~low], names, gradient[~low], weight[~low], depth - 1),
    )


def _value(node: Node, row: dict) -> float:
    while node.feature is not None:
        node = node.low if row[node.feature] <= node.at else node.high
    return node.value


def boost(cells: list[dict], names: list[str], positives: str = "positives", count: str = "n") -> list[Node]:
    """Trees for the log odds of a positive, fitted to ``cells`` of ``names``, ``n`` and ``positives``."""
    if not cells:
        return []
    x = np.array([[c[k] for k in names] for c in cells])
    n, hits = (np.array([c[k] for c in cells], float) for k in (count, positives))
    score, trees = np.zeros(len(cells)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, names, hits - n * p, n * p * (1 - p), DEPTH)
        score += [_value(tree, c) for c in cells]
        trees.append(tree)
    return trees


def predict(trees: list[Node], cell: dict) -> float:
    return sum(_value(t, cell) for t in trees)


def expression(trees: list[Node], feature=F.col) -> Column:
    """The trees' sum as a column; ``feature`` gives the column of a feature's name."""

    def walk(node: Node) -> Column:
        if node.feature is None:
            return F.lit(float(node.value))
        return F.when(feature(node.feature) <= node.at, walk(node.low)).otherwise(walk(node.high))

    out = F.lit(0.0)
    for tree in trees:
        out = out + walk(tree)
    return out


def threshold(cells: list[dict], trees: list[Node], precision: float) -> float:
    """The least score at and above which ``cells`` hold positives at ``precision``; infinite if none does."""
    ranked = sorted(((predict(trees, c), c["positives"], c["n"]) for c in cells), reverse=True)
    best, hits, total = float("inf"), 0, 0
    for i, (score, positives, n) in enumerate(ranked):
        hits, total = hits + positives, total + n
        tied = i + 1 < len(ranked) and ranked[i + 1][0] == score
        if not tied and hits >= precision * total:
            best = score
    return best
