"""Registered temporal, versioning and provenance queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import intervals
from loomwork.operators import lineage, temporal
from loomwork.plans.registry import load, query


@query("asof_join", """SELECT p.event_id, p.user_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(spark, d):
    e = load(spark, d, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    out = temporal.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "value", "last_view")
    return out.select("event_id", "user_id", "last_view")


@query("range_join", """SELECT a.event_id AS error_id, b.event_id AS near_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap_us FROM events a JOIN events b
ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 WHERE a.event_type = 'error' AND b.event_type = 'click'""")
def range_join(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = temporal.within(e.where("event_type = 'error'"), e.where("event_type = 'click'"), "user_id", "ts", 3600)
    return out.select(F.col("l_event_id").alias("error_id"), F.col("r_event_id").alias("near_id"), "gap_us")


@query("temporal_near", """WITH p AS (SELECT a.event_id AS src, b.event_id AS dst, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 172800000000),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY gap, dst) AS r FROM p)
SELECT src, dst, round(1 - gap / 172800000000.0, 9)::DOUBLE AS weight FROM r WHERE r <= 8""")
def temporal_near(spark, d):
    """Edges between a user's events within 48 h, the eight nearest each."""
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    p = temporal.within(e, e, "user_id", "ts", 172800).where("l_event_id <> r_event_id")
    r = F.row_number().over(W.partitionBy("l_event_id").orderBy("gap_us", "r_event_id"))
    out = p.withColumn("r", r).where("r <= 8")
    return out.select(F.col("l_event_id").alias("src"), F.col("r_event_id").alias("dst"), F.round(1 - F.col("gap_us") / 172800000000.0, 9).alias("weight"))


SESS = """g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1)::BIGINT AS session_no FROM g)"""


@query("session_gap", f"WITH {SESS} SELECT user_id, session_no, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM s GROUP BY 1, 2")
def session_gap(spark, d):
    s = temporal.sessions(load(spark, d, "events"), "user_id", "ts", tie="event_id")
    us = lambda c: temporal.micros(c)
    return s.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"), us(F.min("ts")).alias("start_us"), us(F.max("ts")).alias("end_us"))


@query("allen_relation", f"""WITH {SESS}, i AS (SELECT user_id, session_no, epoch_us(min(ts)) AS s1, epoch_us(max(ts)) AS e1 FROM s GROUP BY 1, 2),
n AS (SELECT *, (s1 // 43200000000) * 43200000000 AS s2, (s1 // 43200000000) * 43200000000 + 14400000000 AS e2 FROM i)
SELECT user_id, session_no, CASE WHEN e1 < s2 THEN 'before' WHEN e1 = s2 THEN 'meets' WHEN s1 > e2 THEN 'after' WHEN s1 = e2 THEN 'met_by' WHEN s1 = s2 AND e1 = e2 THEN 'equals'
 WHEN s1 = s2 AND e1 < e2 THEN 'starts' WHEN s1 = s2 THEN 'started_by' WHEN e1 = e2 AND s1 > s2 THEN 'finishes' WHEN e1 = e2 THEN 'finished_by'
 WHEN s1 > s2 AND e1 < e2 THEN 'during' WHEN s1 < s2 AND e1 > e2 THEN 'contains' WHEN s1 < s2 THEN 'overlaps' ELSE 'overlapped_by' END AS relation FROM n""")
def allen_relation(spark, d):
    i = session_gap(spark, d).select("user_id", "session_no", F.col("start_us").alias("s1"), F.col("end_us").alias("e1"))
    i = i.withColumn("s2", F.expr("(s1 div 43200000000) * 43200000000")).withColumn("e2", F.col("s2") + 14400000000)
    return i.select("user_id", "session_no", intervals.allen(*map(F.col, ("s1", "e1", "s2", "e2"))).alias("relation"))


@query("window_proximity", """WITH e AS (SELECT event_id, epoch_us(ts) AS t FROM events), b AS (SELECT 1704844800000000 AS s, 1705708800000000 AS e)
SELECT event_id, round(greatest(0, least(1, 1 - abs(t - (s + (b.e - s) / 2)) / ((b.e - s) / 2))), 9)::DOUBLE AS t_prox FROM e, b WHERE t < b.e AND s < t + 1""")
def window_proximity(spark, d):
    """Events inside [2024-01-10, 2024-01-20), with their proximity to its centre."""
    s, e = F.lit(1704844800000000), F.lit(1705708800000000)
    x = load(spark, d, "events")
    x = x.select("event_id", temporal.micros(F.col("ts")).alias("t")).where(intervals.contains_point(s, e, F.col("t")))
    return x.select("event_id", F.round(intervals.t_prox(F.col("t"), s, e), 9).alias("t_prox"))


@query("latest_version", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_version(spark, d):
    return temporal.latest(load(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", ["event_id", "value"])


@query("known_at", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events
WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE r = 1""")
def known_at(spark, d):
    """Each user's newest record as known at an instant."""
    e = load(spark, d, "events").where(F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return temporal.latest(e, ["user_id"], "ts", "event_id", ["event_id", "value"])


@query("supersession_chain", """SELECT event_id, user_id, epoch_us(ts) AS valid_from, epoch_us(lead(ts) OVER w) AS valid_to, lead(event_id) OVER w IS NULL AS current
FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def supersession_chain(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").where("event_type = 'signup'").withColumn("us", temporal.micros(F.col("ts")))
    return e.select("event_id", "user_id", F.col("us").alias("valid_from"), F.lead("us").over(w).alias("valid_to"), F.lead("event_id").over(w).isNull().alias("current"))


@query("adjacent_turns", """WITH u AS (SELECT conv_id, conv_id * 4294967296 + turn AS unit_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)
SELECT a.unit_id AS src, b.unit_id AS dst, (b.pos - a.pos)::BIGINT AS step FROM u a JOIN u b USING (conv_id) WHERE b.pos - a.pos IN (1, 2)""")
def adjacent_turns(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    u = load(spark, d, "conversations").withColumn("unit_id", F.col("conv_id") * 4294967296 + F.col("turn"))
    u = u.select("unit_id", F.array(*[F.struct(F.lit(k).cast("long").alias("step"), F.lead("unit_id", k).over(w).alias("dst")) for k in (1, 2)]).alias("n"))
    return u.select(F.col("unit_id").alias("src"), F.explode("n").alias("n")).where("n.dst is not null").select("src", "n.dst", "n.step")


@query("descendants", """WITH RECURSIVE u AS (SELECT conv_id, conv_id * 4294967296 + turn AS id, lead(conv_id * 4294967296 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
r AS (SELECT id AS seed, id AS node, 0 AS depth FROM u WHERE id % 1000 = 0 UNION SELECT r.seed, u.nxt, r.depth + 1 FROM r JOIN u ON u.id = r.node WHERE u.nxt IS NOT NULL)
SELECT seed, node, min(depth)::INTEGER AS depth FROM r GROUP BY 1, 2""")
def descendants(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    u = load(spark, d, "conversations").withColumn("id", F.col("conv_id") * 4294967296 + F.col("turn"))
    edges = u.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst is not null")
    return lineage.reach(edges, u.where("id % 1000 = 0").select(F.col("id").alias("node")))


@query("graph_walk", """WITH e AS (SELECT o_custkey AS src, l_suppkey + 1000000 AS dst, count(*)::DOUBLE AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
UNION ALL SELECT l_suppkey + 1000000, o_custkey, count(*)::DOUBLE FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
w AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM e),
p AS (SELECT DISTINCT o_custkey AS node, 0.1::DOUBLE AS p FROM orders WHERE o_custkey <= 10),
r1 AS (SELECT node, sum(r) AS r FROM (SELECT node, p * 0.5 AS r FROM p UNION ALL SELECT dst, p * w * 0.5 FROM p JOIN w ON node = src) GROUP BY 1),
r2 AS (SELECT node, sum(r) AS r FROM (SELECT node, p * 0.5 AS r FROM p UNION ALL SELECT dst, r * w * 0.5 FROM r1 JOIN w ON node = src) GROUP BY 1),
r3 AS (SELECT node, sum(r) AS r FROM (SELECT node, p * 0.5 AS r FROM p UNION ALL SELECT dst, r * w * 0.5 FROM r2 JOIN w ON node = src) GROUP BY 1)
SELECT node, round(r, 9)::DOUBLE AS r FROM r3""")
def graph_walk(spark, d):
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem")
    pair = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", (F.col("l_suppkey") + 1000000).alias("s")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    edges = pair.select(F.col("o_custkey").alias("src"), F.col("s").alias("dst"), "weight").union(pair.select("s", "o_custkey", "weight"))
    seeds = o.where("o_custkey <= 10").select(F.col("o_custkey").alias("node")).distinct().withColumn("p", F.lit(0.1))
    return lineage.walk(edges, seeds).withColumn("r", F.round("r", 9))


# Easter Sundays.
EASTERS = ["1990-04-15", "1991-03-31", "1992-04-19", "1993-04-11", "1994-04-03", "1995-04-16", "1996-04-07", "1997-03-30", "1998-04-12",
           "1999-04-04", "2000-04-23", "2001-04-15", "2002-03-31", "2003-04-20", "2004-04-11", "2005-03-27"]


@query("easter_dates", "SELECT DISTINCT year(o_orderdate)::INTEGER AS y, CASE year(o_orderdate) " + " ".join(f"WHEN {e[:4]} THEN DATE '{e}'" for e in EASTERS) + " END AS easter FROM orders")
def easter_dates(spark, d):
    y = load(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return y.select("y", intervals.easter(F.col("y")).alias("easter"))
