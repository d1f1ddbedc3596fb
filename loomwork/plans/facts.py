"""Registered fact analytics: consolidation, profiles, outcomes, divisions, updates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import scoring
from loomwork.plans.registry import load, query

CLAIMS = "c AS (SELECT event_id, user_id AS subject, event_type AS slot, floor(value / 10)::BIGINT AS value, ts, ts::DATE AS family FROM events)"


def _claims(spark, d):
    """Each event as a claim: (subject, slot, value) with its day as evidence family."""
    e = load(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("slot"), F.floor(F.col("value") / 10).cast("long").alias("value"), "ts", F.to_date("ts").alias("family"))


@query("slot_aggregate", f"""WITH {CLAIMS} SELECT subject, slot, value, count(*) AS n_claims, count(DISTINCT family) AS proof FROM c GROUP BY 1, 2, 3""")
def slot_aggregate(spark, d):
    return _claims(spark, d).groupBy("subject", "slot", "value").agg(F.count(F.lit(1)).alias("n_claims"), F.countDistinct("family").alias("proof"))


@query("consolidation", f"""WITH {CLAIMS} SELECT subject, slot, value, count(DISTINCT family) AS proof_count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
FROM c GROUP BY 1, 2, 3 HAVING count(DISTINCT event_id) >= 2 AND count(DISTINCT family) >= 2""")
def consolidation(spark, d):
    """Observations: values that two units of two evidence families agree on."""
    us = lambda c: F.unix_micros(c.cast("timestamp_ltz"))
    g = _claims(spark, d).groupBy("subject", "slot", "value").agg(
        F.countDistinct("family").alias("proof_count"), F.countDistinct("event_id").alias("n"), us(F.min("ts")).alias("first_us"), us(F.max("ts")).alias("last_us")
    )
    return g.where("n >= 2 and proof_count >= 2").drop("n")


@query("profiles", f"""WITH {CLAIMS} SELECT subject, slot, value, event_id, CASE WHEN row_number() OVER (PARTITION BY subject, slot ORDER BY ts DESC, event_id DESC) = 1 THEN 'current' ELSE 'historical' END AS status FROM c""")
def profiles(spark, d):
    r = F.row_number().over(W.partitionBy("subject", "slot").orderBy(F.desc("ts"), F.desc("event_id")))
    return _claims(spark, d).select("subject", "slot", "value", "event_id", F.when(r == 1, "current").otherwise("historical").alias("status"))


@query("rival_values", f"""WITH {CLAIMS} SELECT subject, slot, count(DISTINCT value) AS n_values, string_agg(DISTINCT value::VARCHAR, ',' ORDER BY value::VARCHAR) AS vals FROM c GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
def rival_values(spark, d):
    g = _claims(spark, d).groupBy("subject", "slot").agg(F.array_sort(F.collect_set(F.col("value").cast("string"))).alias("v"))
    return g.where(F.size("v") > 1).select("subject", "slot", F.size("v").cast("long").alias("n_values"), F.array_join("v", ",").alias("vals"))


@query("update_relations", f"""WITH {CLAIMS}, p AS (SELECT subject, slot, event_id, value, lag(value) OVER w AS prior FROM c WINDOW w AS (PARTITION BY subject, slot ORDER BY ts, event_id))
SELECT event_id, CASE WHEN prior = value THEN 'confirms' WHEN abs(prior - value) <= 1 THEN 'refines' ELSE 'newer_value' END AS relation FROM p WHERE prior IS NOT NULL""")
def update_relations(spark, d):
    c = _claims(spark, d).withColumn("prior", F.lag("value").over(W.partitionBy("subject", "slot").orderBy("ts", "event_id"))).where("prior is not null")
    rel = F.when(F.col("prior") == F.col("value"), "confirms").when(F.abs(F.col("prior") - F.col("value")) <= 1, "refines").otherwise("newer_value")
    return c.select("event_id", rel.alias("relation"))


@query("relational_division", "SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def relational_division(spark, d):
    e = load(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    return e.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n = 3").select("user_id")


@query("outcome_drift", """WITH r AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
g AS (SELECT user_id, avg(CASE WHEN r <= 10 THEN ok::INTEGER END) AS recent, avg(CASE WHEN r > 10 THEN ok::INTEGER END) AS earlier FROM r GROUP BY 1)
SELECT user_id, round(recent, 9) AS recent, round(earlier, 9) AS earlier, CASE WHEN earlier IS NULL THEN 'unknown' WHEN recent < earlier - 0.3 THEN 'degraded' WHEN abs(recent - earlier) > 0.1 THEN 'drifted' ELSE 'stable' END AS state FROM g""")
def outcome_drift(spark, d):
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    e = load(spark, d, "events").withColumn("r", r).withColumn("ok", (F.col("event_type") != "error").cast("int"))
    g = e.groupBy("user_id").agg(F.avg(F.when(F.col("r") <= 10, F.col("ok"))).alias("recent"), F.avg(F.when(F.col("r") > 10, F.col("ok"))).alias("earlier"))
    state = F.when(F.col("earlier").isNull(), "unknown").when(F.col("recent") < F.col("earlier") - 0.3, "degraded").when(F.abs(F.col("recent") - F.col("earlier")) > 0.1, "drifted").otherwise("stable")
    return g.select("user_id", F.round("recent", 9).alias("recent"), F.round("earlier", 9).alias("earlier"), state.alias("state"))


@query("wilson_interval", """WITH g AS (SELECT user_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS k FROM events GROUP BY 1)
SELECT user_id, round((k / n + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588206941236 / (4 * n * n))) / (1 + 3.8414588206941236 / n), 9) AS low,
 round((k / n + 3.8414588206941236 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588206941236 / (4 * n * n))) / (1 + 3.8414588206941236 / n), 9) AS high FROM g""")
def wilson_interval(spark, d):
    g = load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("event_type") == "error").cast("double").alias("k"))
    low, high = scoring.wilson(F.col("k"), F.col("n"))
    return g.select("user_id", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("nearest_rank_percentile", """WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT event_type, v[round_even(0.5 * (len(v) - 1), 0)::BIGINT + 1] AS p50, v[round_even(0.95 * (len(v) - 1), 0)::BIGINT + 1] AS p95 FROM s""")
def nearest_rank_percentile(spark, d):
    """Index round-half-even(q (n - 1)), by rank so that no group is gathered."""
    e = load(spark, d, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    up = F.sum("c").over(W.partitionBy("event_type").orderBy("value"))
    e = e.withColumn("up", up).withColumn("n", F.sum("c").over(W.partitionBy("event_type")))
    at = lambda q: F.min(F.when(F.col("up") > F.bround(F.lit(q) * (F.col("n") - 1)), F.col("value")))
    return e.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("fingerprint", """SELECT user_id, sha256(string_agg(event_id || ':' || event_type, ',' ORDER BY event_id)) AS digest FROM events GROUP BY 1""")
def fingerprint(spark, d):
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.concat_ws(":", x["event_id"].cast("string"), x["event_type"]))
    return load(spark, d, "events").groupBy("user_id").agg(F.sha2(F.array_join(pairs, ",").cast("binary"), 256).alias("digest"))


@query("bucket_spread", """WITH b AS (SELECT event_id, user_id, value, (epoch_us(ts) - 1704067200000000) // 259200000000 AS bucket FROM events WHERE event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY value DESC, event_id) AS r FROM b) SELECT event_id, bucket, r FROM r WHERE r <= 5""")
def bucket_spread(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    b = load(spark, d, "events").where("event_type = 'purchase'").select("event_id", "value", F.floor((us - 1704067200000000) / 259200000000).alias("bucket"))
    r = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("value"), "event_id"))
    return b.withColumn("r", r.cast("long")).where("r <= 5").select("event_id", "bucket", "r")


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_fields(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("tumbling_window", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    w = load(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_micros(F.col("window.start").cast("timestamp_ltz")).alias("start_us"), "event_type", "n", "total")


@query("stream_event_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_event_counts(spark, d):
    """The same counts from a file stream, batch by batch, through an idempotent sink."""
    from loomwork.streaming.incremental import grouped_counts

    return grouped_counts(spark, d, "events", "event_type", "value")
