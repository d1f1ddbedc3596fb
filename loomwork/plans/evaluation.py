"""Registered evaluation operators: dataflow over ranked results and gold sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import scoring
from loomwork.operators import retrieval as R
from loomwork.plans.registry import query
from loomwork.plans.retrieval import BM, _queries, _units

GOLD = "gold AS (SELECT DISTINCT qid, unit_id FROM sc WHERE unit_id % 5 = 0 AND score > 5)"


def _ranked(spark, d):
    """Ranked lists, and a synthetic gold set: every fifth unit scoring above 5."""
    u = _units(spark, d)
    s = R.bm25f(u, _queries(spark, d)).withColumn("score", F.round("score", 6))
    return R.top(s, 10), s.where("unit_id % 5 = 0 and score > 5").select("qid", "unit_id")


@query("retrieval_metrics", f"""WITH {BM}, {GOLD}, t AS (SELECT qid, unit_id, rank FROM bm WHERE rank <= 10), n AS (SELECT qid, count(*) AS n FROM gold GROUP BY 1),
h AS (SELECT qid, count(*) AS hits, sum(ln(2) / ln(rank + 1)) AS dcg, 1.0 / min(rank) AS rr FROM t JOIN gold USING (qid, unit_id) GROUP BY 1),
ideal AS (SELECT qid, sum(ln(2) / ln(i + 1)) AS idcg FROM (SELECT qid, unnest(range(1, least(n, 10) + 1)) AS i FROM n) GROUP BY 1)
SELECT qid, round(coalesce(hits, 0) / n::DOUBLE, 6) AS recall, round(coalesce(dcg, 0) / idcg, 6) AS ndcg, round(coalesce(rr, 0), 6)::DOUBLE AS mrr FROM n JOIN ideal USING (qid) LEFT JOIN h USING (qid)""")
def retrieval_metrics(spark, d):
    """recall@10, nDCG@10 and reciprocal rank; queries without gold have no row."""
    top, gold = _ranked(spark, d)
    n = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    h = top.join(gold, ["qid", "unit_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.sum(scoring.ndcg_gain(F.col("rank"))).alias("dcg"), (1 / F.min("rank")).alias("rr"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(10))), F.lit(0.0), lambda a, i: a + scoring.ndcg_gain(i))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    j = n.join(h, "qid", "left")
    return j.select("qid", F.round(z(F.col("hits").cast("double")) / F.col("n"), 6).alias("recall"), F.round(z(F.col("dcg")) / ideal, 6).alias("ndcg"), F.round(z(F.col("rr")), 6).alias("mrr"))


@query("miss_attribution", f"""WITH {BM}, {GOLD} SELECT qid, unit_id, CASE WHEN rank <= 10 THEN 'delivered' WHEN rank <= 50 THEN 'rank_shift' ELSE 'lane_miss' END AS outcome FROM gold JOIN bm USING (qid, unit_id)""")
def miss_attribution(spark, d):
    u = _units(spark, d)
    s = R.top(R.bm25f(u, _queries(spark, d)), 1 << 30)
    out = F.when(F.col("rank") <= 10, "delivered").when(F.col("rank") <= 50, "rank_shift").otherwise("lane_miss")
    return s.where("unit_id % 5 = 0 and score > 5").select("qid", "unit_id", out.alias("outcome"))


@query("constant_signal", """WITH c AS (SELECT event_type, value::INTEGER % 3 AS v, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, max(n) >= 0.9 * sum(n) AS constant FROM c GROUP BY 1""")
def constant_signal(spark, d):
    from loomwork.plans.registry import load

    c = load(spark, d, "events").groupBy("event_type", (F.bround("value").cast("int") % 3).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("event_type").agg((F.max("n") >= 0.9 * F.sum("n")).alias("constant"))
