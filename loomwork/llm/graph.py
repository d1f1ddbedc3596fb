"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(u long, v long)``, roots excepted.

    ``root`` is the smallest node of the component.  Every round joins the
    edges with per-node minima; a hub's edges are a skewed join side, which
    AQE splits, and its minimum is pre-aggregated.  No node's neighbour list
    is ever gathered.  Self loops and repeated edges are allowed; an empty
    edge table gives an empty result.
    """
    cur = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = scratch.save(cur, "cc0")
    seen = _signature(cur)
    for k in range(1, max_rounds + 1):
        if seen[0] == 0:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"cc{k}l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"cc{k}")
        scratch.drop(f"cc{k - 1}")
        scratch.drop(f"cc{k}l")
        cur, now = new, _signature(new)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge per node that keeps the components of the edges a-b."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inv[: len(a)], inv[len(a) :]
    lab = np.arange(len(nodes))
    while True:
        la, lb = lab[ia], lab[ib]
        open_ = la != lb
        if not open_.any():
            break
        ia, ib, la, lb = ia[open_], ib[open_], la[open_], lb[open_]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    own = lab != np.arange(len(nodes))
    return nodes[own], nodes[lab[own]]
