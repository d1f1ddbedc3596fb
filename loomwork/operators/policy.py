"""Lifecycle decisions as joins with small tables of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators import lineage


def replay(log: DataFrame, moves: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``log`` with `before` and `verdict`: whether each command's move from the state asked before is allowed.

    ``log`` has (key, state); ``moves(src, dst)`` lists the allowed moves, a null
    src the allowed first states.  A move to the same state is a no-op.
    """
    before = F.lag("state").over(W.partitionBy(key).orderBy(*order))
    rows = log.withColumn("before", before)
    allowed = moves.select(F.col("src").alias("m_src"), F.col("dst").alias("m_dst"), F.lit(True).alias("m_ok"))
    hit = rows.join(F.broadcast(allowed), F.col("before").eqNullSafe(F.col("m_src")) & (F.col("state") == F.col("m_dst")), "left")  # a table of rules
    verdict = F.when(F.col("before") == F.col("state"), "same").when(F.col("m_ok"), "accepted").otherwise("refused")
    return hit.withColumn("verdict", verdict).drop("m_src", "m_dst", "m_ok")


def readiness(states: DataFrame, needs: DataFrame) -> DataFrame:
    """(item, capability, ready): done, and all capabilities it needs, directly or not, done for that item.

    ``states(item, capability, done)``, ``needs(capability, needs)``: a graph of rules.
    """
    seeds = needs.select(F.col("capability").alias("node")).union(needs.select("needs")).distinct()
    closed = lineage.reach(needs.select(F.col("capability").alias("src"), F.col("needs").alias("dst")), seeds).select(F.col("seed").alias("capability"), F.col("node").alias("needs"))
    lacking = states.where("not done").select("item", F.col("capability").alias("needs"))
    blocked = lacking.join(closed, "needs").select("item", "capability").distinct().withColumn("blocked", F.lit(True))
    return states.join(blocked, ["item", "capability"], "left").select("item", "capability", (F.col("done") & F.col("blocked").isNull()).alias("ready"))


def admit(keys: DataFrame, verdicts: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, admitted): every key, found or not among the ids that its kind admits."""
    admitted = None
    for kind, ids in verdicts.items():
        part = ids.select(F.lit(kind).alias("kind"), "id").distinct()
        admitted = part if admitted is None else admitted.unionByName(part)
    hit = admitted.withColumn("admitted", F.lit(True))
    return keys.join(hit, ["kind", "id"], "left").select("kind", "id", F.coalesce("admitted", F.lit(False)).alias("admitted"))
