"""Retrieval lanes that callers plug in by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Registry:
    """Named functions from a context table to (unit_id long, score double)."""

    def __init__(self):
        self._lanes: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        if name in self._lanes:
            raise ValueError(f"{name} is registered twice")
        self._lanes[name] = fn

    def names(self) -> list[str]:
        return sorted(self._lanes)

    def run(self, context: DataFrame, names: list[str]) -> DataFrame:
        """(lane, unit_id, score) of the lanes asked for; an unknown lane is an error."""
        if not names or set(names) - set(self._lanes):
            raise KeyError(f"no such lane: {sorted(set(names) - set(self._lanes))}")
        parts = [self._lanes[n](context).select(F.lit(n).alias("lane"), F.col("unit_id").cast("long").alias("unit_id"), F.col("score").cast("double").alias("score")) for n in names]
        return reduce(DataFrame.unionByName, parts)


class Features:
    """Named, weighted functions that give a Column each; a null feature counts as neutral, 0.5."""

    def __init__(self):
        self._features: dict[str, tuple[float, Callable[[], Column]]] = {}

    def register(self, name: str, weight: float, fn: Callable[[], Column]) -> None:
        if name in self._features:
            raise ValueError(f"{name} is registered twice")
        self._features[name] = (weight, fn)

    def score(self) -> Column:
        return reduce(lambda a, b: a + b, (w * F.coalesce(fn(), F.lit(0.5)) for w, fn in self._features.values()))
