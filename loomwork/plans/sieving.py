"""Registered event tuples, coreference, repair, hierarchy and routing queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators import sieve, temporal
from loomwork.plans.registry import load, query

PEOPLE = ["Ann", "Bob", "Eve", "Ian"]


def _said(spark, d):
    """Sentences written from the events, a session for each user."""
    who = F.element_at(F.array(*map(F.lit, PEOPLE)), (F.col("event_id") % 4 + 1).cast("int"))
    said = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("I bought a lamp, and "), who, F.lit(" never called mother")))
        .when(F.col("event_type") == "signup", F.concat(who, F.lit(" joined the club")))
        .when(F.col("event_type") == "view", F.lit("then she left"))
        .otherwise(F.concat(F.lit("it was "), F.col("event_type")))
    )
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, d, "events").select(F.col("event_id").alias("unit_id"), F.col("user_id").alias("session_id"), seq.alias("seq"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("speaker"), said.alias("text"))


WHO = "['ann', 'bob', 'eve', 'ian'][(event_id % 4 + 1)::INTEGER]"


@query("event_tuples", f"""SELECT event_id AS unit_id, 'u' || user_id AS subject, 'acquire' AS family, 'bought' AS verb, 'lamp' AS object, false AS negated FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, {WHO}, 'meet', 'called', 'mother', true FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, {WHO}, 'start', 'joined', 'club', false FROM events WHERE event_type = 'signup'""")
def event_tuples(spark, d):
    return sieve.events(_said(spark, d))


@query("antecedents", """WITH n AS (SELECT event_id, event_type, list_distinct(list(CASE WHEN event_type = 'purchase' THEN ['Ann', 'Bob', 'Eve', 'Ian'][(event_id % 4 + 1)::INTEGER] END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS names FROM events)
SELECT event_id AS unit_id, CASE WHEN len(names) = 1 THEN names[1] END AS antecedent FROM n WHERE event_type = 'view'""")
def antecedents(spark, d):
    return sieve.antecedents(_said(spark, d))


@query("text_ratio")
def text_ratio(spark, d):
    """Neighbouring statements of a slot that are at least 0.9 alike; tests hold the ratio against difflib."""
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = load(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("prior"), "props", F.lag("props").over(w).alias("before")).where("prior is not null")
    return e.select("event_id", "prior", F.round(sieve.ratio("props", "before"), 6).alias("ratio")).where("ratio >= 0.9")


@query("local_repair", "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def local_repair(spark, d):
    """Totals of the first twenty days, repaired where later events changed them: equal to a full rebuild."""
    e = load(spark, d, "events")
    late = F.col("ts") >= F.lit("2024-01-21").cast("timestamp_ntz")
    total = lambda x: x.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sieve.repair(total(e.where(~late)), e, e.where(late), ["user_id", "event_type"], total)


@query("hierarchy", """SELECT n_regionkey AS scene, c_nationkey AS episode, count(DISTINCT c_custkey) AS envelopes, count(o_orderkey) AS spans FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def hierarchy(spark, d):
    """Scene, episode, envelope and span levels as a chain of joins; spans are counted before they travel."""
    spans = load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("spans"))
    c = load(spark, d, "customer").join(spans, F.col("o_custkey") == F.col("c_custkey"), "left")
    g = c.groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("envelopes"), F.coalesce(F.sum("spans"), F.lit(0)).alias("spans"))
    return g.join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("scene"), F.col("c_nationkey").alias("episode"), "envelopes", "spans")


@query("transition_anchors", "SELECT event_id, lag(event_type) OVER w AS pre, lead(event_type) OVER w AS post FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def transition_anchors(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("event_id", F.lag("event_type").over(w).alias("pre"), F.lead("event_type").over(w).alias("post"))


@query("bucket_interleave", """WITH b AS (SELECT event_id, (epoch_us(ts) - 1704067200000000) // 259200000000 AS bucket, value FROM events WHERE event_type = 'signup'),
r AS (SELECT event_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY value DESC, event_id) AS turn FROM b) SELECT event_id, row_number() OVER (ORDER BY turn, bucket) AS place FROM r QUALIFY place <= 100""")
def bucket_interleave(spark, d):
    """Round robin over the time buckets; the lane's pool of 100 is the feature."""
    b = load(spark, d, "events").where("event_type = 'signup'").select("event_id", "value", F.floor((temporal.micros(F.col("ts")) - 1704067200000000) / 259200000000).alias("bucket"))
    turn = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("value"), "event_id"))
    few = b.withColumn("turn", turn).orderBy("turn", "bucket").limit(100)
    return few.select("event_id", F.row_number().over(W.orderBy("turn", "bucket")).cast("long").alias("place"))


@query("route_plan", """WITH s AS (SELECT user_id, count(*) >= 40 AS busy, count(*) FILTER (WHERE event_type = 'error') > 0 AS failing FROM events GROUP BY 1), r(busy, failing, lanes, budget) AS (VALUES (true, true, 'lexical,graph,obs', 200), (true, false, 'lexical,graph', 100), (false, true, 'lexical,obs', 100), (false, false, 'lexical', 50))
SELECT user_id, lanes, budget FROM s JOIN r USING (busy, failing)""")
def route_plan(spark, d):
    """Discretised state joined with a routing table of four rows."""
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(b).alias("busy"), F.lit(f).alias("failing"), F.lit(x).alias("lanes"), F.lit(n).alias("budget")) for b, f, x, n in (
        (True, True, "lexical,graph,obs", 200), (True, False, "lexical,graph", 100), (False, True, "lexical,obs", 100), (False, False, "lexical", 50))])))
    s = load(spark, d, "events").groupBy("user_id").agg((F.count(F.lit(1)) >= 40).alias("busy"), (F.count_if(F.col("event_type") == "error") > 0).alias("failing"))
    return s.join(F.broadcast(rules), ["busy", "failing"]).select("user_id", "lanes", "budget")
