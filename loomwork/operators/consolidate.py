"""Keeping derived tables current: touched slots, cursors, blocks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def beliefs(facts: DataFrame) -> DataFrame:
    """(slot, value, proof, rivals, first, last): each slot's best-proven value and how many others it has.

    ``facts``: (slot, value, at).  Ties go to the newer, then the smaller value.
    """
    v = facts.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("proof"), F.min("at").alias("first"), F.max("at").alias("last"))
    best = F.max(F.struct("proof", "last", (-F.xxhash64("value")).alias("h"), "value", "first"))
    return v.groupBy("slot").agg(best.alias("b"), (F.count(F.lit(1)) - 1).alias("rivals")).select("slot", "b.value", "b.proof", "rivals", "b.first", "b.last")


def windowed(stored: DataFrame, facts: DataFrame, since) -> DataFrame:
    """``stored`` beliefs brought up to date: only slots touched from ``since`` on are worked out again."""
    touched = facts.where(F.col("at") >= since).select("slot").distinct()
    fresh = beliefs(facts.join(touched, "slot", "left_semi"))
    return stored.join(touched, "slot", "left_anti").unionByName(fresh)


def past_cursor(rows: DataFrame, cursor: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows not seen so far, and the cursor after them.

    ``cursor``: (shard, mark): everything up to the mark has been seen; rows
    (shard, seq) beyond it are new, whatever order they come in.
    """
    fresh = rows.join(cursor, "shard", "left").where(F.col("mark").isNull() | (F.col("seq") > F.col("mark"))).drop("mark")
    after = cursor.unionByName(fresh.groupBy("shard").agg(F.max("seq").alias("mark"))).groupBy("shard").agg(F.max("mark").alias("mark"))
    return fresh, after


def blocks(rows: DataFrame, space: str, order: str, size: int = 512) -> DataFrame:
    """``rows`` with their block number and place when each space is packed in blocks of ``size`` rows without gaps.

    Two levels: rows are numbered within 4,096-wide ranges of a hash-free order
    column, and ranges by running counts, so that a large space is no one window.
    """
    r = rows.withColumn("range", F.floor(F.col(order) / 4096).cast("long"))
    counts = r.groupBy(space, "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy(space).orderBy("range")) - F.col("n")).select(space, "range", "before")
    at = F.row_number().over(W.partitionBy(space, "range").orderBy(order)) - 1
    r = r.withColumn("i", at).join(before, [space, "range"]).withColumn("i", F.col("i") + F.col("before"))
    return r.withColumn("block", F.floor(F.col("i") / size).cast("long")).withColumn("place", (F.col("i") % size).cast("long")).drop("range", "i", "before")
