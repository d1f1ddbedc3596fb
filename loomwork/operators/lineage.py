"""Walks over derivation edges by iterated joins."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.scratch import Scratch


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, node, depth): nodes reached from each seed with their least depth.

    ``edges(src, dst)``; safe on cycles; goes on until a round finds nothing new,
    or for ``depth`` rounds where a walk of bounded length is asked for.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    edges = edges.select("src", "dst").distinct()
    seen = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0))
    seen = scratch.save(seen, "r0")
    for k in itertools.count(1) if depth is None else range(1, depth + 1):
        ahead = seen.where(F.col("depth") == k - 1).join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        fresh = ahead.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(k))
        new = scratch.save(seen.unionByName(fresh), f"r{k}")
        done = not new.where(F.col("depth") == k).limit(1).count()
        scratch.drop(f"r{k - 1}")
        seen = new
        if done:
            break
    return seen


def walk(edges: DataFrame, seeds: DataFrame, rounds: int = 3, damping: float = 0.5) -> DataFrame:
    """(node, r): ``rounds`` power iterations r <- (1 - damping) p + damping W'r over (src, dst, weight).

    ``seeds(node, p)``.  W is row-normalised; edges count in the direction given.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    w = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("w"))
    r = seeds.select("node", F.col("p").alias("r"))
    base = seeds.select("node", (F.col("p") * (1 - damping)).alias("r"))
    for _ in range(rounds):
        moved = r.join(w, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("r") * F.col("w") * damping).alias("r"))
        r = base.unionByName(moved).groupBy("node").agg(F.sum("r").alias("r"))
    return r
