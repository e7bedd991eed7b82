"""Gradient boosting over binned features, fitted on counts and applied as a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TREES = 24
RATE = 0.3
SMOOTH = 2.0


def _leaf(gradient: float, hessian: float) -> float:
    return gradient / (hessian + SMOOTH)


def fit(features: np.ndarray, positive: np.ndarray, total: np.ndarray, trees: int = TREES) -> tuple[float, list]:
    """(base score, trees) of logistic loss over distinct rows of small integers with counts.

    A tree has two levels: (feature, bound, left, right), where a side is (feature, bound, value, value) or a value.
    """
    base = float(np.log((positive.sum() + 1) / (total.sum() - positive.sum() + 1)))
    score, out = np.full(len(total), base), []
    splits = [(j, b) for j in range(features.shape[1]) for b in np.unique(features[:, j])[:-1]]

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        found, gain = None, 1e-6
        for j, b in splits:
            left = rows & (features[:, j] <= b)
            right = rows & ~left
            if left.any() and right.any():
                got = sum(g[s].sum() ** 2 / (h[s].sum() + SMOOTH) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + SMOOTH)
                if got > gain:
                    found, gain = (j, int(b), left, right), got
        return found

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - total * p, total * p * (1 - p)
        top = best(np.ones(len(total), bool), g, h)
        if top is None:
            break
        j, b, left, right = top
        sides = []
        for rows in (left, right):
            deeper = best(rows, g, h)
            parts = [deeper[2], deeper[3]] if deeper else [rows]
            values = [RATE * _leaf(g[s].sum(), h[s].sum()) for s in parts]
            for s, v in zip(parts, values):
                score[s] += v
            sides.append((deeper[0], deeper[1], *values) if deeper else values[0])
        out.append((j, b, *sides))
    return base, out


def score(columns: list[Column], base: float, trees: list) -> Column:
    """Log-odds as built-in expressions."""
    def side(s):
        return F.lit(s) if isinstance(s, float) else F.when(columns[s[0]] <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))

    total = F.lit(base)
    for j, b, left, right in trees:
        total = total + F.when(columns[j] <= b, side(left)).otherwise(side(right))
    return total


def score_rows(features: np.ndarray, base: float, trees: list) -> np.ndarray:
    def side(s):
        return np.full(len(features), s) if isinstance(s, float) else np.where(features[:, s[0]] <= s[1], s[2], s[3])

    total = np.full(len(features), base)
    for j, b, left, right in trees:
        total += np.where(features[:, j] <= b, side(left), side(right))
    return total


def threshold(scores: np.ndarray, positive: np.ndarray, total: np.ndarray, precision: float) -> float:
    """Least score at and above which held-out rows are positive at the given precision (an infinite one if never)."""
    order = np.argsort(-scores, kind="stable")
    s, p, t = scores[order], np.cumsum(positive[order]), np.cumsum(total[order])
    last = np.append(s[1:] != s[:-1], True)  # equal scores stand or fall together
    good = np.flatnonzero(last & (p >= precision * t))
    return float(s[good[-1]]) if len(good) else float("inf")
