"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked.  Every document starts in the shard its
id hashes to; rounds of joins then move the pieces of a text class towards the
shard where most of the class already lies, as far as that shard's quota for
linked rows has room.  A last pass evens the counts to at most one apart,
moving unlinked rows first, so that few links are cut.

Two exits end the propagation early: no piece moved in two rounds, or ``rounds``
is reached; a shard with less than a tenth of its quota free attracts nothing.
All affect the number of cut links only, never the law or any row.

The propagation runs on (class, start shard) pieces, not rows: a class that
holds a third of all rows is at most ``shards * FINE`` pieces.  The driver sees one
row per shard and round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.scratch import Scratch

CLS = ["h", "crc", "size"]
FINE = 4  # pieces of a class per start shard


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, rounds: int = 24) -> DataFrame:
    """(id, size, crc, shard, slot): counts of any two shards differ by at most one.

    size: UTF-8 bytes plus 16 (null: 16); crc: CRC-32 of the UTF-8 text (null:
    that of the empty text).  Null texts are linked with nothing; empty texts
    are equal texts.  Slots run from 0 without gaps in every shard.  Repeated
    ids are separate rows.  An empty table gives an empty result; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.col(text_col).cast("string")
    own = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("crc"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("h"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(shards * FINE)).cast("int").alias("s0"),
    )
    own = scratch.save(own, "own")
    rows = own.count()
    pieces = own.where("h is not null").groupBy(*CLS, "s0").agg(F.count(F.lit(1)).alias("n"))
    pieces = scratch.save(pieces, "pieces")
    linked = pieces.groupBy(*CLS).agg(F.sum("n").alias("all")).where("all > 1").select(*CLS)
    pieces = scratch.save(pieces.join(linked, CLS).withColumn("s", F.col("s0") % shards), "p0")
    pieces = _propagate(pieces, scratch, rows // shards, shards, rounds)

    placed = own.join(pieces.drop("n"), [*CLS, "s0"], "left")
    split = max(4, rows // (shards * 2000))
    bucket = F.pmod(F.xxhash64("id", "h", F.lit(1)), F.lit(split)).cast("int")
    placed = placed.select(
        "id", "size", "crc", "h", F.coalesce("s", F.col("s0") % shards).alias("s"), F.when(F.col("s").isNotNull(), bucket).otherwise(bucket + split).alias("b")
    )
    placed = scratch.save(placed, "placed")
    counts = placed.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("s", "b", (F.sum("n").over(W.partitionBy("s").orderBy("b")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("s", "b").orderBy("id", "h", "crc")) - 1
    ranked = placed.withColumn("r", rank).join(offsets, ["s", "b"]).withColumn("pos", (F.col("before") + F.col("r")).cast("long"))

    have = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # one row per shard
    load = [have.get(s, 0) for s in range(shards)]
    extra = set(sorted(range(shards), key=lambda s: (-load[s], s))[: rows % shards])
    goal = [rows // shards + (s in extra) for s in range(shards)]
    surplus, ends, at, end = [], [], 0, 0
    for s in range(shards):
        surplus.append(at)
        at += max(0, load[s] - goal[s])
        if goal[s] > load[s]:
            end += goal[s] - load[s]
            ends.append((end, s))
    mover = F.col("pos") - _at(goal, F.col("s")) + _at(surplus, F.col("s"))
    target = reduce(lambda rest, e: F.when(F.col("g") < e[0], F.lit(e[1])).otherwise(rest), reversed(ends), F.lit(None).cast("int"))
    first = [0] * shards
    for k, (_, s) in enumerate(ends):
        first[s] = (ends[k - 1][0] if k else 0) - load[s]
    stays = F.col("pos") < _at(goal, F.col("s"))
    out = ranked.withColumn("g", mover).withColumn("to", F.when(stays, F.col("s")).otherwise(target))
    slot = F.when(stays, F.col("pos")).otherwise(F.col("g") - _at(first, F.col("to")))
    return out.select("id", "size", "crc", F.col("to").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def _propagate(pieces: DataFrame, scratch: Scratch, quota: int, shards: int, rounds: int) -> DataFrame:
    idle = 0
    for k in range(rounds):
        load = {r["s"]: r["n"] for r in pieces.groupBy("s").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, quota - load.get(s, 0)) for s in range(shards)]
        held = pieces.groupBy(*CLS, "s").agg(F.sum("n").alias("held"))
        # a nearly full shard would attract a class and take none of it
        open_ = held.where(_at(room, F.col("s")) > quota // 10)
        best = open_.groupBy(*CLS).agg(F.max(F.struct("held", (-F.col("s")).alias("neg"))).alias("best"))
        want = pieces.join(held, [*CLS, "s"]).join(best, CLS, "left")
        gain = (F.col("best") > F.struct("held", (-F.col("s")).alias("neg"))) & (-F.col("best.neg") != F.col("s"))
        want = want.withColumn("to", F.when(gain, -F.col("best.neg")))
        want = scratch.save(want.select(*CLS, "s0", "n", "s", "to"), f"w{k}")
        # quotas: movers to a shard are let in by hash order while they fit; sums
        # over 4096 hash ranges find the cut of each shard
        luck = F.pmod(F.xxhash64(*CLS, "s0", F.lit(k)), F.lit(4096)).cast("int")
        asked = want.where("to is not null").groupBy("to", luck.alias("luck")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("to").orderBy("luck"))
        cuts = asked.withColumn("upto", upto).groupBy("to").agg(F.max(F.when(F.col("upto") <= _at(room, F.col("to")), F.col("luck"))).alias("cut"))
        cut = {r["to"]: r["cut"] for r in cuts.collect()}  # one row per shard
        if not cut:
            break
        allowed = [cut[s] if cut.get(s) is not None else -1 for s in range(shards)]
        moves = F.col("to").isNotNull() & (luck <= _at(allowed, F.col("to")))
        new = want.select(*CLS, "s0", "n", F.when(moves, F.col("to")).otherwise(F.col("s")).alias("s"), moves.alias("moved"))
        new = scratch.save(new, f"p{k + 1}")
        scratch.drop(f"p{k}")
        scratch.drop(f"w{k}")
        idle = 0 if new.where("moved").limit(1).count() else idle + 1
        pieces = new.drop("moved")
        if idle > 1:
            break
    return pieces


def _at(values: list, index: Column, kind: str = "long") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), index.cast("int") + 1)


def op3_shard_label_propagation(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
