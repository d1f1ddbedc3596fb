"""Registered evaluation of paired arms: tests, intervals, ablations, keep rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import scoring, trials
from loomwork.operators import retrieval as R
from loomwork.plans.registry import load, query
from loomwork.plans.retrieval import FUSE, _queries, _units

# Two arms judge each event by a threshold; truth is whether it is a purchase.
ARMS = """a AS (SELECT event_id, user_id % 7 AS category, ((value > 60) = (event_type = 'purchase'))::INTEGER AS x, ((value > 75) = (event_type = 'purchase'))::INTEGER AS y FROM events WHERE value IS NOT NULL)"""


def _arms(spark, d):
    right = lambda t: ((F.col("value") > t) == (F.col("event_type") == "purchase")).cast("int")
    e = load(spark, d, "events").where("value is not null")
    return e.select("event_id", (F.col("user_id") % 7).alias("category"), right(60).alias("x"), right(75).alias("y"))


@query("mcnemar_test", f"""WITH {ARMS}, g AS (SELECT category, count(*) FILTER (WHERE x > y) AS b, count(*) FILTER (WHERE x < y) AS c FROM a GROUP BY 1),
t AS (SELECT category, b, c, unnest(range(0, least(b, c) + 1)) AS i FROM g)
SELECT category, b, c, round(least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))), 6) AS p FROM t GROUP BY 1, 2, 3""")
def mcnemar_test(spark, d):
    g = _arms(spark, d).groupBy("category").agg(F.count_if(F.col("x") > F.col("y")).alias("b"), F.count_if(F.col("x") < F.col("y")).alias("c"))
    return g.select("category", "b", "c", F.round(trials.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


@query("paired_bootstrap")
def paired_bootstrap(spark, d):
    """Seeded intervals of the arms' difference by category; tests hold them against theory."""
    return trials.paired_bootstrap(_arms(spark, d).select("category", (F.col("y") - F.col("x")).alias("diff")), "category", "diff")


@query("keep_rule", f"""WITH {ARMS}, g AS (SELECT category, avg(y - x) AS d FROM a GROUP BY 1), t AS (SELECT avg(y - x) AS gain, avg(y - x) - 1.959963984540054 * stddev_samp(y - x) / sqrt(count(*)) AS low FROM a)
SELECT round(gain, 9) AS gain, round(low, 9) AS low, round(min(d), 9) AS worst, gain >= 0.01 AND low > 0 AND min(d) >= -0.005 AS kept FROM t, g GROUP BY gain, low""")
def keep_rule(spark, d):
    a = _arms(spark, d).select("category", (F.col("y") - F.col("x")).alias("diff"))
    t = a.agg(F.avg("diff").alias("gain"), (F.avg("diff") - 1.959963984540054 * F.stddev_samp("diff") / F.sqrt(F.count(F.lit(1)))).alias("low"))
    w = a.groupBy("category").agg(F.avg("diff").alias("c")).agg(F.min("c").alias("worst"))
    r = t.join(F.broadcast(w))  # one row each
    return r.select(F.round("gain", 9).alias("gain"), F.round("low", 9).alias("low"), F.round("worst", 9).alias("worst"), trials.keep(F.col("gain"), F.col("low"), F.col("worst")).alias("kept"))


@query("category_means", f"WITH {ARMS} SELECT category, count(*) AS n, round(avg(x), 9) AS x_rate, round(avg(y), 9) AS y_rate FROM a GROUP BY 1")
def category_means(spark, d):
    return _arms(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 9).alias("x_rate"), F.round(F.avg("y"), 9).alias("y_rate"))


@query("scaling_exponent", """WITH d AS (SELECT day(ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1), c AS (SELECT day, sum(n) OVER (ORDER BY day) AS n, sum(users) OVER (ORDER BY day) AS users FROM d)
SELECT day::INTEGER AS day, round(ln(users / first_value(users) OVER w) / ln(n / first_value(n) OVER w), 6) AS alpha FROM c WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER w > 1""")
def scaling_exponent(spark, d):
    """Slope of ln(cost) over ln(size) from the first day on; below 1 is sub-linear. One row per day of a month."""
    g = load(spark, d, "events").groupBy(F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    c = g.select("day", F.sum("n").over(w).alias("n"), F.sum("users").over(w).alias("users"))
    slope = F.log(F.col("users") / F.first("users").over(w)) / F.log(F.col("n") / F.first("n").over(w))
    return c.withColumn("alpha", F.round(slope, 6)).withColumn("r", F.row_number().over(W.orderBy("day"))).where("r > 1").select("day", "alpha")


@query("lane_ablation", f"""WITH {FUSE}, parts AS (SELECT qid, unit_id, 'lexical' AS lane, 1.0::DOUBLE / (60 + rank) AS part FROM lex UNION ALL SELECT qid, unit_id, 'coverage', 0.5::DOUBLE / (60 + rank) FROM cr WHERE rank <= 50),
t AS (SELECT qid, unit_id, sum(part) AS s FROM parts GROUP BY 1, 2), l AS (SELECT qid, unit_id, o.lane AS dropped, round(s - coalesce(p.part, 0), 9) AS rrf FROM t CROSS JOIN (VALUES ('lexical'), ('coverage')) o(lane) LEFT JOIN parts p USING (qid, unit_id, lane)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, dropped ORDER BY rrf DESC, unit_id) AS rank FROM l WHERE rrf > 0) SELECT qid, dropped, unit_id, rrf, rank FROM r WHERE rank <= 5""")
def lane_ablation(spark, d):
    """The fused five best with each lane left out in turn; the lanes are scored once."""
    u, q = _units(spark, d), _queries(spark, d)
    p = R.postings(u, ["text"]).select("unit_id", "term").distinct()
    coverage = p.join(R.query_terms(q), "term").groupBy("qid", "unit_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    part = lambda df, lane, w: R.top(df, 50).select("qid", "unit_id", F.lit(lane).alias("lane"), scoring.rrf(F.lit(w), F.col("rank")).alias("part"))
    parts = part(R.bm25f(u, q), "lexical", 1.0).unionByName(part(coverage, "coverage", 0.5))
    # one pass: each lane's part beside the sum
    g = parts.groupBy("qid", "unit_id").agg(*[F.sum(F.when(F.col("lane") == x, F.col("part")).otherwise(0.0)).alias(x) for x in ("lexical", "coverage")])
    out = g.select("qid", "unit_id", F.explode(F.create_map(F.lit("lexical"), F.round("coverage", 9), F.lit("coverage"), F.round("lexical", 9))).alias("dropped", "rrf")).where("rrf > 0")
    r = F.row_number().over(W.partitionBy("qid", "dropped").orderBy(F.desc("rrf"), "unit_id")).cast("long")
    return out.withColumn("rank", r).where("rank <= 5").select("qid", "dropped", "unit_id", "rrf", "rank")
