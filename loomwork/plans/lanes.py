"""Registered lanes and answers beyond the lexical one."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import scoring, text
from loomwork.operators import packing, retrieval as R, temporal
from loomwork.plans.registry import load, query
from loomwork.plans.retrieval import BM, POSTINGS, UNITS, _queries, _units, tok
from loomwork.plans.textual import MENTION

ENT = f"""{UNITS}, m AS (SELECT DISTINCT unit_id, lower(unnest(regexp_extract_all(text, '{MENTION}'))) AS canon FROM u),
c AS (SELECT canon, count(*) AS df FROM m GROUP BY 1)"""


def _mentions(spark, d):
    return _units(spark, d).select("unit_id", F.explode(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).alias("s")).select("unit_id", F.lower("s").alias("canon")).distinct()


@query("entity_lane", f"""WITH {ENT}, n AS (SELECT count(*) AS n FROM u), q AS (SELECT DISTINCT item_id AS qid, lower(unnest(regexp_extract_all(text, '{MENTION}'))) AS canon FROM benchmark),
w AS (SELECT qid, unit_id, count(*) AS hits, sum(CASE WHEN df > 0.3 * n THEN 0.1 * greatest(0, ln((n - 0.5) / 1.5)) ELSE greatest(0, ln((n - df + 0.5) / (df + 0.5))) END) AS s FROM q JOIN m USING (canon) JOIN c USING (canon), n GROUP BY 1, 2)
SELECT qid, unit_id, hits, round(s + CASE WHEN hits >= 2 THEN ln(1 + hits - 1) ELSE 0 END, 5) AS score FROM w""")
def entity_lane(spark, d):
    m = _mentions(spark, d)
    n = _units(spark, d).agg(F.count(F.lit(1)).alias("n"))
    df = m.groupBy("canon").agg(F.count(F.lit(1)).alias("df"))
    q = load(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).alias("s")).select("qid", F.lower("s").alias("canon")).distinct()
    x = q.join(m, "canon").join(df, "canon").join(F.broadcast(n))  # n is one row
    floor = lambda v: F.greatest(F.lit(0.0), v)
    w = F.when(F.col("df") > 0.3 * F.col("n"), 0.1 * floor(F.log((F.col("n") - 0.5) / 1.5))).otherwise(floor(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    g = x.groupBy("qid", "unit_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(w).alias("s"))
    return g.select("qid", "unit_id", "hits", F.round(F.col("s") + F.when(F.col("hits") >= 2, F.log(F.col("hits").cast("double"))).otherwise(0.0), 5).alias("score"))


@query("co_mention_edges", f"""WITH {ENT}, o AS (SELECT DISTINCT canon, unit_id, df FROM m JOIN c USING (canon) WHERE df >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY unit_id) AS pos FROM o)
SELECT a.unit_id AS src, b.unit_id AS dst, round(sum(1.0 / a.df), 9)::DOUBLE AS weight FROM k a JOIN k b ON a.canon = b.canon AND b.pos - a.pos BETWEEN 1 AND 8 GROUP BY 1, 2""")
def co_mention_edges(spark, d):
    """Units sharing a canon, 1/df each: every mention with its next eight in order, so a frequent canon costs no more a mention.

    Edges point from the earlier unit to the later one; walks use them both ways.
    """
    m = _mentions(spark, d).select("canon", "unit_id").distinct()
    df = m.groupBy("canon").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    w = W.partitionBy("canon").orderBy("unit_id")
    ahead = F.array(*[F.lead("unit_id", k).over(w) for k in range(1, 9)])
    e = m.join(df, "canon").select(F.col("unit_id").alias("src"), "df", ahead.alias("ahead"))
    e = e.select("src", "df", F.explode("ahead").alias("dst")).where("dst is not null")
    return e.groupBy("src", "dst").agg(F.round(F.sum(1 / F.col("df")), 9).alias("weight"))


@query("phrase_flag", f"""WITH {BM} SELECT qid, unit_id, contains(' ' || array_to_string({tok('u.text')}, ' ') || ' ', ' ' || array_to_string(({tok('q.query')})[1:2], ' ') || ' ') AS phrase
FROM bm JOIN u USING (unit_id) JOIN q USING (qid) WHERE rank <= 20""")
def phrase_flag(spark, d):
    u, q = _units(spark, d), _queries(spark, d)
    pad = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    t = R.top(R.bm25f(u, q), 20).join(u.select("unit_id", "text"), "unit_id").join(q, "qid")
    return t.select("qid", "unit_id", F.contains(pad(text.tokens(F.col("text"))), pad(F.slice(text.tokens(F.col("query")), 1, 2))).alias("phrase"))


def coverage(spark, d, k: int = 20):
    """(qid, unit_id, score, rank, cov_idf) of the first k units of each query."""
    u, q = _units(spark, d), _queries(spark, d)
    p = R.postings(u)
    n = u.agg(F.count(F.lit(1)).alias("n"))
    df = R.document_frequency(p, by_field=False)
    qi = R.query_terms(q).join(df, "term", "left").join(F.broadcast(n)).withColumn("idf", scoring.idf(F.col("n"), F.coalesce("df", F.lit(0))))
    total = qi.groupBy("qid").agg(F.sum("idf").alias("total"))
    got = qi.join(p.select("unit_id", "term").distinct(), "term").groupBy("qid", "unit_id").agg(F.sum("idf").alias("got"))
    c = R.top(R.bm25f(u, q), k).join(got, ["qid", "unit_id"]).join(total, "qid")
    return c.withColumn("cov_idf", F.round(F.col("got") / F.col("total"), 6)).drop("got", "total")


COV = f"""{BM}, dd AS (SELECT term, count(DISTINCT unit_id) AS df FROM p GROUP BY 1), nn AS (SELECT count(*) AS n FROM u),
qi AS (SELECT qid, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM qt LEFT JOIN dd USING (term), nn),
tot AS (SELECT qid, sum(idf) AS total FROM qi GROUP BY 1),
cv AS (SELECT qid, unit_id, sum(idf) AS got FROM qi JOIN (SELECT DISTINCT unit_id, term FROM p) USING (term) GROUP BY 1, 2),
cov AS (SELECT bm.qid, bm.unit_id, round(got / total, 6) AS cov_idf FROM bm JOIN cv USING (qid, unit_id) JOIN tot USING (qid) WHERE rank <= 20)"""


@query("coverage_verdict", f"WITH {COV} SELECT qid, unit_id, cov_idf, CASE WHEN cov_idf >= 0.6 THEN 'supported' WHEN cov_idf >= 0.25 THEN 'partial' ELSE 'weak' END AS label FROM cov")
def coverage_verdict(spark, d):
    """Share of the query's idf that a unit covers, and its support band."""
    c = coverage(spark, d)
    label = F.when(F.col("cov_idf") >= 0.6, "supported").when(F.col("cov_idf") >= 0.25, "partial").otherwise("weak")
    return c.select("qid", "unit_id", "cov_idf", label.alias("label"))


@query("intent_class", """SELECT item_id, CASE WHEN regexp_matches(t, 'http|@|[0-9a-f]{8}') THEN 'identifier' WHEN regexp_matches(t, '\\bhow (long|many days)\\b') THEN 'duration' WHEN regexp_matches(t, '\\bhow many\\b') THEN 'count'
WHEN regexp_matches(t, '\\b(current|now|latest)\\b') THEN 'current_value' WHEN regexp_matches(t, '\\b(history|previous|formerly)\\b') THEN 'history' WHEN regexp_matches(t, '\\b(why|because)\\b') THEN 'why' WHEN regexp_matches(t, '\\b(when|date)\\b') THEN 'temporal'
ELSE 'lookup' END AS intent FROM (SELECT item_id, lower(text) AS t FROM benchmark)""".replace("\\\\", "\\"))
def intent_class(spark, d):
    return load(spark, d, "benchmark").select("item_id", packing.intent(F.lower("text")).alias("intent"))


@query("packed_evidence", None)
def packed_evidence(spark, d):
    """Ranked hits packed greedily under a token budget; order-dependent, so tested against a plain loop."""
    u = _units(spark, d)
    t = R.top(R.bm25f(u, _queries(spark, d)), 50).join(u.select("unit_id", text.token_estimate(F.col("text")).alias("tokens")), "unit_id")
    return packing.pack(t.select("qid", "unit_id", "rank", "tokens"), budget=800)


@query("timeline", """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place,
 (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // 86400000000 AS days_since_first FROM events WHERE event_type = 'purchase'""")
def timeline(spark, d):
    e = load(spark, d, "events").where("event_type = 'purchase'").withColumn("us", temporal.micros(F.col("ts")))
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    first = F.min("us").over(W.partitionBy("user_id"))
    return e.select("user_id", "event_id", place.alias("place"), F.floor((F.col("us") - first) / 86400000000).alias("days_since_first"))


@query("observation_lane", """WITH c AS (SELECT user_id, event_type, count(DISTINCT ts::DATE) AS proof, max(ts) AS last FROM events GROUP BY 1, 2)
SELECT user_id, event_type, round(1 + 0.2 * ln(1 + proof), 6) AS score, last < TIMESTAMP '2024-01-15' AS stale FROM c""")
def observation_lane(spark, d):
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.countDistinct(F.to_date("ts")).alias("proof"), F.max("ts").alias("last"))
    return c.select("user_id", "event_type", F.round(1 + 0.2 * F.log(1 + F.col("proof").cast("double")), 6).alias("score"), (F.col("last") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("stale"))


@query("role_channel", f"WITH {POSTINGS} SELECT term AS role, count(DISTINCT unit_id) AS units FROM p WHERE field = 'speaker' GROUP BY 1")
def role_channel(spark, d):
    return R.postings(_units(spark, d), ["speaker"]).groupBy(F.col("term").alias("role")).agg(F.countDistinct("unit_id").alias("units"))
