"""Ranking arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking model.
K1 = 1.2
FIELD_WEIGHTS = {"text": 1.0, "entities": 0.8, "when": 0.6, "speaker": 0.3, "session": 0.2}
FIELD_B = {"text": 0.75, "entities": 0.3, "when": 0.0, "speaker": 0.0, "session": 0.5}
RRF_K = 60


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturate(tf: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1)


def rrf(weight: Column, rank: Column) -> Column:
    return weight / (RRF_K + rank)


def cosine(a: Column, b: Column) -> Column:
    """Double-precision cosine; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def boost(recency: Column, proximity: Column, proof: Column) -> Column:
    """Product of bounded factors around 1, clamped to [0.75, 1.30]."""
    f = (1 + 0.2 * (recency - 0.5)) * (1 + 0.2 * (proximity - 0.5)) * (1 + 0.1 * (proof - 0.5))
    return F.least(F.greatest(f, F.lit(0.75)), F.lit(1.30))


def wilson(good: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    p = good / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def ndcg_gain(rank: Column) -> Column:
    return math.log(2) / F.log(rank + 1)
