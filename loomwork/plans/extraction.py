"""Registered extractors and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import encoder, intervals, stem, timephrases
from loomwork.operators import extract, retrieval as R
from loomwork.plans.registry import load, query
from loomwork.plans.retrieval import UNITS, tok


def _units(spark, d):
    return R.units(load(spark, d, "conversations"))


@query("episode_segmentation", f"""WITH {UNITS}, t AS (SELECT unit_id, session_id, seq, list_distinct({tok('text')}) AS t FROM u),
g AS (SELECT *, list_distinct(flatten(list(t) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))) AS a, list_distinct(flatten(list(t) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))) AS b FROM t WINDOW w AS (PARTITION BY session_id ORDER BY seq, unit_id)),
c AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / sqrt(len(a)::DOUBLE * len(b)), 9) END AS gap FROM g),
m AS (SELECT *, avg(gap) OVER s AS mean, stddev_pop(gap) OVER s AS dev, count(*) OVER s AS n FROM c WINDOW s AS (PARTITION BY session_id))
SELECT unit_id, session_id, sum(CASE WHEN n >= 3 AND gap < mean - dev AND gap <= mean / 2 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq, unit_id ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM m""")
def episode_segmentation(spark, d):
    return extract.episodes(_units(spark, d))


SAID = """(1, 'The build broke because the cache was full. We paused as a result of the alert!'), (2, 'Rain fell, so the game moved. It was so much fun.'),
(3, 'Tests failed; therefore we waited. As a result, nobody shipped. Costs rose due to demand'), (4, 'The key leaked, which is why we rotated it? Because of rain'), (5, 'So be it. nothing here, also'), (6, NULL)"""

# the expected rows, read off the sentences above by hand
CAUSES = """(1, 0, 'because', 'The build broke', 'the cache was full'), (1, 1, 'as a result of', 'We paused', 'the alert'), (2, 0, 'so', 'the game moved', 'Rain fell'),
(3, 0, 'therefore', 'we waited', 'Tests failed'), (3, 2, 'due to', 'Costs rose', 'demand'), (4, 0, 'which is why', 'we rotated it', 'The key leaked')"""


@query("causal_pairs", f"SELECT unit_id::BIGINT AS unit_id, sentence::BIGINT AS sentence, connective, effect, cause FROM (VALUES {CAUSES}) AS v(unit_id, sentence, connective, effect, cause)")
def causal_pairs(spark, d):
    """Explicit causes in all units (invented words, so none) and in stated sentences."""
    said = spark.sql(f"SELECT CAST(unit_id AS BIGINT) AS unit_id, text FROM VALUES {SAID} AS v(unit_id, text)")
    return extract.causal_pairs(_units(spark, d).where("unit_id > 6").select("unit_id", "text").unionByName(said))


@query("stemmed_vocabulary")
def stemmed_vocabulary(spark, d):
    """Porter stems of the distinct terms, with how many terms share each."""
    terms = R.postings(_units(spark, d), ["text"]).select("term").distinct()
    return terms.withColumn("stem", stem.stem("term")).groupBy("stem").agg(F.count(F.lit(1)).alias("terms"))


@query("hashed_embeddings")
def hashed_embeddings(spark, d):
    return _units(spark, d).select("unit_id", encoder.embed("text").alias("vector"))


@query("time_phrases")
def time_phrases(spark, d):
    """Phrases such as `N days ago`, written from the events and resolved against their times."""
    e = load(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    t = F.concat(F.lit("seen "), (F.col("user_id") % 9 + 1).cast("string"), F.lit(" days ago and again last week"))
    x = e.select("event_id", F.explode(timephrases.time_phrases(t, us)).alias("p"))
    return x.select("event_id", "p.*")


@query("calendar_months", """WITH x AS (SELECT o_orderkey, o_orderdate::DATE AS s, l_shipdate::DATE AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_shipdate >= o_orderdate),
k AS (SELECT *, date_diff('month', s, e) - CASE WHEN s + to_months(date_diff('month', s, e)::INTEGER) > e THEN 1 ELSE 0 END AS k FROM x)
SELECT o_orderkey, k AS months, round(k + date_diff('day', (s + to_months(k::INTEGER))::DATE, e)::DOUBLE / date_diff('day', (s + to_months(k::INTEGER))::DATE, (s + to_months(k::INTEGER + 1))::DATE), 9) AS duration FROM k""")
def calendar_months(spark, d):
    """Whole months by clamped addition plus the share of the month in progress."""
    o = load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("s"), "o_orderdate")
    l = load(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.to_date("l_shipdate").alias("e"), "l_shipdate")
    x = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    k = (F.year("e") - F.year("s")) * 12 + F.month("e") - F.month("s")
    x = x.withColumn("k", k).withColumn("k", F.col("k") - (F.add_months("s", F.col("k")) > F.col("e")).cast("int"))
    a, b = F.add_months("s", F.col("k")), F.add_months("s", F.col("k") + 1)
    return x.select("o_orderkey", F.col("k").cast("long").alias("months"), F.round(F.col("k") + F.date_diff("e", a) / F.date_diff(b, a), 9).alias("duration"))


@query("next_recurrence", """WITH x AS (SELECT DISTINCT o_orderdate::DATE AS anchor FROM orders), o AS (SELECT anchor, unnest(range(0, 200)) AS k FROM x)
SELECT anchor, min(CASE WHEN (anchor + to_months(k::INTEGER))::DATE > DATE '2001-03-31' THEN (anchor + to_months(k::INTEGER))::DATE END) AS due FROM o GROUP BY 1""")
def next_recurrence(spark, d):
    """The monthly recurrence of each order date strictly after a day."""
    x = load(spark, d, "orders").select(F.to_date("o_orderdate").alias("anchor")).distinct()
    return x.select("anchor", intervals.next_monthly(F.col("anchor"), F.lit("2001-03-31").cast("date")).alias("due"))
