"""Statistics of paired trials."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p-value of b against c discordant pairs; 1 without any.

    Terms are summed in logarithms, so that large counts don't underflow.
    """
    n, low = (b + c).cast("long"), F.least(b, c).cast("long")
    start = F.struct((n * -math.log(2)).alias("term"), F.lit(0.0).alias("sum"))

    def add(a, i):
        step = F.struct((a["term"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum"))
        last = F.struct(a["term"].alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum"))
        return F.when(i < n, step).otherwise(last)

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low), start, add, lambda a: a["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired_bootstrap(diffs: DataFrame, key: str, value: str, resamples: int = 10_000, level: float = 0.95, seed: int = 17) -> DataFrame:
    """(key, n, mean, low, high): percentile interval of the mean paired difference.

    Differences are first counted by value, so a category of any size reaches
    its task as its distinct values; a resample is a multinomial draw of them.
    Null differences take no part.
    """
    counts = diffs.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    kind = dict(diffs.dtypes)[key]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("v")
        v, c = g["v"].to_numpy(), g["c"].to_numpy()
        n = int(c.sum())
        rng = np.random.default_rng(seed)
        means = np.concatenate([rng.multinomial(n, c / n, size=min(500, resamples - lo)) @ v / n for lo in range(0, resamples, 500)])
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({key: g[key].iloc[:1], "n": [n], "mean": [float(c @ v / n)], "low": [low], "high": [high]})

    return counts.groupBy(key).applyInPandas(run, f"{key} {kind}, n long, mean double, low double, high double")


def keep(gain: Column, low: Column, worst: Column, least: float = 0.010, drop: float = -0.005) -> Column:
    """Keep a change that gains enough with its interval above zero, and loses in no category."""
    return (gain >= least) & (low > 0) & (worst >= drop)
