"""Mixing sources to target weights by Pfair scheduling, DataFrame operations only.

A source's documents, in hash order, form blocks.  Sources share the slots in
proportion to their weights; one that runs dry leaves its share to the others.
Let I_s(t) be what source s has received after t slots of that ideal, fractional
schedule.  Block i of s is released at the last whole slot before I_s reaches
i - 1 and due at the first whole slot after it reaches i; earliest deadline
first among the released blocks fills one slot at a time.  As the fractional
schedule meets all windows, so does this one, hence every source stays within
one block of I_s(t) at every slot.

Weights are used exactly (as rationals), never rounded, and every source has its
own.  The driver plans whole blocks, ``slots`` of them at most and one for each
source at least: above ``slots * block_rows`` rows a block has more rows.  Spark
counts, ranks and places the rows.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REST = -1


def whole(weights: list) -> list[int]:
    """The exact ratios of the weights, as whole numbers."""
    parts = [Fraction(w) for w in weights]
    scale = math.lcm(*(p.denominator for p in parts)) if parts else 1
    out = [int(p * scale) for p in parts]
    shared = math.gcd(*out) if out else 1
    return [x // max(shared, 1) for x in out]


class Ideal:
    """The fractional schedule: sources of ``blocks`` blocks, served by whole ``weights``."""

    def __init__(self, blocks: list[int], weights: list[int]):
        # virtual time v: each live source has received v * weight
        order = sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], weights[s]))
        self.ends = [(blocks[s], weights[s]) for s in order]
        self.near = np.array([n / w for n, w in self.ends])
        self.used, self.live = [0], [sum(weights)]
        for n, w in self.ends:
            self.used.append(self.used[-1] + n)
            self.live.append(self.live[-1] - w)

    def phase(self, i: int, w: int, guess: int) -> int:
        """How many sources have run dry before virtual time i / w."""
        while guess and self.ends[guess - 1][0] * w >= i * self.ends[guess - 1][1]:
            guess -= 1
        while guess < len(self.ends) and self.ends[guess][0] * w < i * self.ends[guess][1]:
            guess += 1
        return guess

    def at(self, i: int, w: int, phase: int) -> Fraction:
        """The slot, as a fraction, at which a source of weight w has received i blocks."""
        return self.used[phase] + Fraction(i * self.live[phase], w)

    def windows(self, n: int, w: int) -> list[tuple[int, int, int]]:
        """(release, deadline, phase) of each of a source's n blocks."""
        guess = np.searchsorted(self.near, np.arange(n + 1) / w)
        out, last = [], (0, 1)
        for i in range(1, n + 1):
            k = self.phase(i, w, int(guess[i]))
            top = i * self.live[k]
            out.append((last[0], self.used[k] - (-top // w), k))
            last = (self.used[k] + top // w, k)
        return out


def schedule(blocks: list[int], weights: list) -> list[list[tuple[int, int]]]:
    """(slot, phase) of every block of every source, earliest deadline first.

    Each slot from 0 to the number of blocks is used once.
    """
    ratios = whole(weights)
    ideal = Ideal(blocks, ratios)
    jobs = sorted((r, d, s, i, k) for s, (n, w) in enumerate(zip(blocks, ratios)) for i, (r, d, k) in enumerate(ideal.windows(n, w)))
    out: list[list[tuple[int, int]]] = [[] for _ in blocks]
    ready: list[tuple[int, int, int, int]] = []
    at = 0
    for t in range(len(jobs)):
        while at < len(jobs) and jobs[at][0] <= t:
            heapq.heappush(ready, jobs[at][1:])
            at += 1
        d, s, _, k = heapq.heappop(ready)
        if d <= t:
            raise AssertionError("a deadline was missed")
        out[s].append((t, k))
    return out


def _plan(spark, rows: list[dict]) -> DataFrame:
    kind = "array<struct<g:bigint,w:array<double>,s:array<bigint>,p:array<int>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def _row_hash(docs: DataFrame, id_col: str) -> Column:
    """A hash of the whole row: rows share it only if they are equal (or by 2^-64)."""
    cols = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(F.col(id_col), *[F.col(f"`{c}`") for c in sorted(cols) if c != id_col])


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = 8,
    slots: int = 1 << 17,
    alpha: float = 0.5,
) -> DataFrame:
    """``docs`` with mix_group, mix_block, mix_slot, mix_position, mix_phase, mix_weight.

    ``weights`` gives each source's target (relative, positive, any number of
    sources, floats or exact fractions); sources it leaves out share one group
    with the mean weight.  Without it, a source of n rows weighs n ** alpha.  A
    null source is a source of its own; a null id is a value like others;
    repeated rows are separate rows, and only rows equal in every column are
    ranked in one task.  A block has ``block_rows`` rows, or more where the rows
    would fill over ``slots`` blocks; the driver holds a plan of that many
    numbers, and the number of sources.  Every source stays within one block of
    its target at every slot; when a source is used up, the others' targets grow
    in proportion.  mix_phase counts the sources used up before a block is due,
    mix_weight is the block's target share then.  mix_position is the order of
    the mixture (not gapless where a source's last block is short).  An empty
    table gives an empty result.  Extra columns pass through whatever their
    names; columns with the six names above are replaced.
    """
    spark = docs.sparkSession
    if weights is not None and any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    added = ["mix_group", "mix_block", "mix_slot", "mix_position", "mix_phase", "mix_weight"]
    cols = [c for c in docs.columns if c not in added]
    key = F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    group = F.xxhash64(key)
    if weights is not None:
        group = F.when(key.isin(*["=" + k for k in weights]), group).otherwise(F.lit(REST).cast("long"))
    # the operator's own columns live in one struct, apart from the input's
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), group.alias("g"), _row_hash(docs.select(*[F.col(f"`{c}`") for c in cols]), id_col).alias("h"))

    counts = docs.select(group.alias("g"), key.alias("k")).groupBy("g").agg(F.min("k").alias("k"), F.max("k").alias("k2"), F.count(F.lit(1)).alias("n")).collect()
    counts = sorted(counts, key=lambda r: (r["g"] == REST, r["k"]))
    if any(r["k"] != r["k2"] for r in counts if r["g"] != REST or weights is None):
        raise ValueError("two sources share a hash")
    rows = sum(r["n"] for r in counts)
    size = max(block_rows, -(-rows // slots))
    if weights is None:
        shares = [r["n"] ** alpha for r in counts]
    else:
        mean = sum(Fraction(w) for w in weights.values()) / max(len(weights), 1)
        shares = [mean if r["g"] == REST else weights[r["k"][1:]] for r in counts]
    blocks = [-(-r["n"] // size) for r in counts]
    ratios = whole(shares)
    live = Ideal(blocks, ratios).live
    places = schedule(blocks, shares)
    table = [
        {"g": r["g"], "s": [t for t, _ in own_], "p": [k for _, k in own_], "w": [w / live[k] for _, k in own_]}
        for r, own_, w in zip(counts, places, ratios)
    ]
    plan = _plan(spark, table).select("g", F.posexplode(F.arrays_zip("s", "p", "w")).alias("b", "x")).select("g", "b", "x.s", "x.p", "x.w")

    # rank within the source by hash: bucket of the hash's leading bits, then row number
    bits = max(1, math.ceil(math.log2(max(2, rows / 2000))))
    own = own.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    small = own.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("g").orderBy("bucket")) - F.col("n")
    small = small.select("g", "bucket", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("g", "bucket").orderBy("h")) - 1
    own = own.withColumn("r", rank).join(small, ["g", "bucket"]).withColumn("seq", F.col("r") + F.col("before"))
    own = own.withColumn("b", F.expr(f"cast(seq div {size} as int)"))
    out = own.join(plan, ["g", "b"])
    position = F.col("s") * size + F.expr(f"seq % {size}")
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in cols], F.col("g").alias("mix_group"), F.col("b").cast("long").alias("mix_block"),
        F.col("s").alias("mix_slot"), position.alias("mix_position"), F.col("p").alias("mix_phase"), F.col("w").alias("mix_weight"),
    )


def op4_pfair_mix(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = {"mix_block": "block", "mix_slot": "slot", "mix_position": "position", "mix_phase": "phase", "mix_weight": "weight"}
    return out.select("doc_id", "source", *[F.col(a).alias(b) for a, b in names.items()])
