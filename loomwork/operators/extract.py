"""Row-generating extractors over units, as JVM-side regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text
from loomwork.operators import entities

# fixed values: the explicit connectives, longest first, and the side on which the cause stands
CONNECTIVES = (
    ("which is why", r"which\s+is\s+why", "before"),
    ("as a result of", r"as\s+a\s+result\s+of", "after"),
    ("as a result", r"as\s+a\s+result", "before"),
    ("because", r"because", "after"),
    ("due to", r"due\s+to", "after"),
    ("therefore", r"therefore", "before"),
    ("so", r"so", "before"),
)
NOT_AFTER_SO = ("that", "this", "much", "many", "few", "little", "far", "long", "often")


def causal_pairs(units: DataFrame) -> DataFrame:
    """(unit_id, sentence, connective, effect, cause): each sentence's first connective, both clauses non-empty.

    Sentences end at . ! or ?; of connectives that start at one place the longest wins.
    """
    s = units.select("unit_id", F.posexplode(F.split("text", r"[.!?]+", -1)).alias("sentence", "t"))
    word = "(?i)(?<![A-Za-z0-9_])(" + "|".join(p for _, p, _ in CONNECTIVES[:-1]) + r"|so(?!\s+(?:" + "|".join(NOT_AFTER_SO) + r")(?![A-Za-z0-9_])))(?![A-Za-z0-9_])"
    s = s.withColumn("at", F.regexp_instr("t", F.lit(word))).where("at > 0").withColumn("hit", F.regexp_substr("t", F.lit(word)))
    s = s.withColumn("connective", F.lower(F.regexp_replace("hit", r"\s+", " ")))
    clean = lambda c: F.regexp_replace(c, r"^[\s,;:]+|[\s,;:]+$", "")
    left, right = clean(F.expr("substring(t, 1, at - 1)")), clean(F.expr("substring(t, at + length(hit))"))
    after = F.col("connective").isin(*[n for n, _, side in CONNECTIVES if side == "after"])
    s = s.select("unit_id", F.col("sentence").cast("long").alias("sentence"), "connective", F.when(after, left).otherwise(right).alias("effect"), F.when(after, right).otherwise(left).alias("cause"))
    return s.where("effect <> '' and cause <> ''")


def aliases(canons: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """(alias, canon, rule, status) of multi-token canons(canon).

    A1: a proper token subset of exactly one canon is active, of several a
    candidate for each (A6).  A2: first name and initial, likewise.  Explicit
    statements (alias, canon) are active (A3) and win.
    """
    subset = entities.subset_aliases(canons).select("alias", "canon", F.lit("A1").alias("rule"))
    initial = entities.initial_aliases(canons).withColumn("rule", F.lit("A2"))
    rows = subset.unionByName(initial)
    n = rows.groupBy("alias").agg(F.countDistinct("canon").alias("n"))
    rows = rows.join(n, "alias").select("alias", "canon", F.when(F.col("n") > 1, "A6").otherwise(F.col("rule")).alias("rule"), F.when(F.col("n") > 1, "candidate").otherwise("active").alias("status"))
    if stated is None:
        return rows
    given = stated.select("alias", "canon", F.lit("A3").alias("rule"), F.lit("active").alias("status")).distinct()
    return given.unionByName(rows.join(given.select("alias"), "alias", "left_anti"))


def episodes(units: DataFrame) -> DataFrame:
    """(unit_id, session_id, episode): topical segments of sessions of three turns or more.

    The gap before a turn is the set cosine of the two turns before it and the
    two from it on; a gap strictly below mean - deviation and at most half the
    mean of its session starts an episode.
    """
    w = W.partitionBy("session_id").orderBy("seq", "unit_id")
    u = units.select("unit_id", "session_id", "seq", F.array_distinct(text.tokens(F.col("text"))).alias("t"))
    u = u.withColumn("a", F.flatten(F.collect_list("t").over(w.rowsBetween(-2, -1)))).withColumn("b", F.flatten(F.collect_list("t").over(w.rowsBetween(0, 1))))
    a, b = F.array_distinct("a"), F.array_distinct("b")
    size = F.sqrt(F.size("a").cast("double") * F.size("b"))
    u = u.withColumn("a", a).withColumn("b", b).withColumn("gap", F.when(size > 0, F.round(F.size(F.array_intersect("a", "b")) / size, 9)))
    return cut_episodes(u)


def cut_episodes(u: DataFrame) -> DataFrame:
    """(unit_id, session_id, episode) of units with the gap before them (null: none)."""
    w = W.partitionBy("session_id").orderBy("seq", "unit_id")
    # mean and deviation by Welford's steps in turn order: of two gaps the lower is mean - deviation, and the rounding of these steps decides
    gaps = F.transform(F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("seq", "unit_id", "gap")))), lambda x: x["gap"])

    def step(acc, x):
        k = acc["k"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / k
        return F.struct(k.alias("k"), (acc["sum"] + x).alias("sum"), mean.alias("mean"), (acc["sq"] + (x - mean) * (x - acc["mean"])).alias("sq"))

    start = F.struct(*[F.lit(0.0).alias(c) for c in ("k", "sum", "mean", "sq")])
    each = u.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), gaps.alias("gaps")).withColumn("m", F.aggregate("gaps", start, step))
    each = each.where("m.k > 0").select(F.col("session_id").alias("of"), "n", (F.col("m.sum") / F.col("m.k")).alias("mean"), F.sqrt(F.col("m.sq") / F.col("m.k")).alias("dev"))
    u = u.join(each, F.col("session_id").eqNullSafe(F.col("of")), "left")
    cut = (F.col("n") >= 3) & (F.col("gap") < F.col("mean") - F.col("dev")) & (F.col("gap") <= F.col("mean") / 2)
    u = u.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("long"))
    return u.select("unit_id", "session_id", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("episode"))
