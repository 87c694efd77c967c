"""Gradient-boosted depth-two trees for a few labelled examples, and their form as Spark expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple[int, float, tuple[int, float, float, float], tuple[int, float, float, float]]


def _leaf(g: Sequence[float], h: Sequence[float], rows: Sequence[int]) -> float:
    return sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1.0)


def _split(x: Sequence[Sequence[float]], g: Sequence[float], h: Sequence[float], rows: list[int]) -> tuple[int, float, list[int], list[int]]:
    """The feature and threshold with the largest gain; thresholds lie between neighbouring values."""
    gain = lambda part: sum(g[i] for i in part) ** 2 / (sum(h[i] for i in part) + 1.0)
    best = (-1.0, 0, math.inf, rows, [])
    for f in range(len(x[0])):
        values = sorted({x[i][f] for i in rows})
        for a, b in zip(values, values[1:]):
            low, high = [i for i in rows if x[i][f] <= a], [i for i in rows if x[i][f] > a]
            score = gain(low) + gain(high)
            if score > best[0]:
                best = (score, f, (a + b) / 2, low, high)
    return best[1:]


def fit(x: Sequence[Sequence[float]], y: Sequence[int], trees: int = 12, rate: float = 0.4) -> list[Tree]:
    """Trees whose summed leaves are log-odds. The rows are a bounded sample of labelled examples."""
    score, out = [0.0] * len(y), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [t - q for t, q in zip(y, p)], [q * (1 - q) for q in p]
        f, cut, low, high = _split(x, g, h, list(range(len(y))))
        sides = []
        for rows in (low, high):
            if rows:
                f2, cut2, low2, high2 = _split(x, g, h, rows)
                leaves = [rate * _leaf(g, h, part) if part else 0.0 for part in (low2, high2)]
            else:
                f2, cut2, leaves = 0, math.inf, [0.0, 0.0]
            sides.append((f2, cut2, *leaves))
        out.append((f, cut, *sides))
        score = [s + value(out[-1:], row) for s, row in zip(score, x)]
    return out


def value(trees: Sequence[Tree], row: Sequence[float]) -> float:
    """The log-odds of one row."""
    total = 0.0
    for f, cut, low, high in trees:
        f2, cut2, a, b = low if row[f] <= cut else high
        total += a if row[f2] <= cut2 else b
    return total


def calibrate(scores: Sequence[float], y: Sequence[int]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out scores (Platt), by a few Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = [1 / (1 + math.exp(-max(-30, min(30, a * s + b)))) for s in scores]
        ga, gb = sum((q - t) * s for q, t, s in zip(p, y, scores)) + 1e-2 * (a - 1), sum(q - t for q, t in zip(p, y)) + 1e-2 * b
        w = [q * (1 - q) for q in p]
        haa, hab, hbb = sum(v * s * s for v, s in zip(w, scores)) + 1e-2, sum(v * s for v, s in zip(w, scores)), sum(w) + 1e-2
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return a, b


def expression(trees: Sequence[Tree], features: Sequence[Column]) -> Column:
    """The log-odds as nested conditions over the feature columns."""

    def side(f: int, cut: float, a: float, b: float) -> Column:
        return F.lit(a) if math.isinf(cut) or a == b else F.when(features[f] <= cut, F.lit(a)).otherwise(F.lit(b))

    total = F.lit(0.0)
    for f, cut, low, high in trees:
        total = total + (side(*low) if math.isinf(cut) else F.when(features[f] <= cut, side(*low)).otherwise(side(*high)))
    return total
