"""Registered composite lanes: temporal, two-phase dense, facets, merged edges, calibration."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import intervals, scoring, text
from loomwork.operators import retrieval as R, temporal
from loomwork.plans.registry import load, query
from loomwork.plans.retrieval import BM, _queries, _units, tok

LO, HI = 1704844800000000, 1705708800000000  # 2024-01-10 to 2024-01-20


@query("temporal_lane", f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events WHERE epoch_us(ts) >= {LO} AND epoch_us(ts) < {HI}),
s AS (SELECT event_id, round(1.5 * (event_type = 'purchase')::INTEGER + 1.0 * (user_id % 10 = 0)::INTEGER + 0.25 * (1 - abs(t - {(LO + HI) // 2}) / {(HI - LO) / 2}), 6)::DOUBLE AS score, (t - {LO}) // 86400000000 AS bucket FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, event_id) AS r FROM s) SELECT event_id, bucket, score FROM r WHERE r <= 4""")
def temporal_lane(spark, d):
    """Composite score inside a window, spread over its days: four events a day."""
    e = load(spark, d, "events").withColumn("t", temporal.micros(F.col("ts"))).where((F.col("t") >= LO) & (F.col("t") < HI))
    one = lambda c: c.cast("int")
    score = 1.5 * one(F.col("event_type") == "purchase") + 1.0 * one(F.col("user_id") % 10 == 0) + 0.25 * intervals.t_prox(F.col("t"), F.lit(LO), F.lit(HI))
    s = e.select("event_id", F.round(score, 6).alias("score"), F.floor((F.col("t") - LO) / 86400000000).alias("bucket"))
    r = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("score"), "event_id"))
    return s.withColumn("r", r).where("r <= 4").select("event_id", "bucket", "score")


@query("two_phase_topk", """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS qv FROM embeddings WHERE vec_id = 0),
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id <> 0),
c AS (SELECT vec_id, v, list_transform(v, lambda x: round(x / (list_max(list_transform(v, lambda y: abs(y))) / 127))) AS code FROM e),
a AS (SELECT vec_id, v, round(list_cosine_similarity(code, qv), 6) AS rough, qv FROM c, q),
t AS (SELECT * FROM a ORDER BY rough DESC, vec_id LIMIT 40)
SELECT vec_id, round(list_cosine_similarity(v, qv), 6) AS score FROM t ORDER BY score DESC, vec_id LIMIT 10""")
def two_phase_topk(spark, d):
    """Int8 codes keep four times k, exact products decide; both limits are the feature."""
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id = 0").select(F.col("v").alias("qv")).limit(1)
    scale = F.array_max(F.transform("v", F.abs)) / 127
    c = e.where("vec_id <> 0").withColumn("scale", scale).withColumn("code", F.transform("v", lambda x: F.round(x / F.col("scale"))))
    a = c.join(F.broadcast(q)).withColumn("rough", F.round(scoring.cosine(F.col("code"), F.col("qv")), 6))
    t = a.orderBy(F.desc("rough"), "vec_id").limit(40).withColumn("score", F.round(scoring.cosine(F.col("v"), F.col("qv")), 6))
    return t.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "score")


@query("facet_bonus", f"""WITH {BM}, fc AS (SELECT qid, facet, list_distinct({tok('part')}) AS w FROM (SELECT qid, unnest(string_split(query, ',')[1:3]) AS part, unnest(range(0, least(3, len(string_split(query, ','))))) AS facet FROM q)),
ft AS (SELECT qid, facet, unnest(w) AS term FROM fc), rare AS (SELECT qid, facet, arg_min(term, (df, term)) AS term FROM ft JOIN df USING (term) GROUP BY 1, 2),
c AS (SELECT qid, unit_id, count(DISTINCT facet) AS covered FROM rare JOIN (SELECT DISTINCT unit_id, term FROM p) USING (term) GROUP BY 1, 2)
SELECT bm.qid, bm.unit_id, round(1.0 / (60 + rank) + least(0.5 * (greatest(coalesce(covered, 0), 1) - 1), 1) / (60 + rank), 9)::DOUBLE AS score FROM bm LEFT JOIN c USING (qid, unit_id) WHERE rank <= 50""")
def facet_bonus(spark, d):
    """Rank score plus min(0.5 (covered - 1), 1) / (60 + rank): facets are a query's first three clauses, covered by a clause's rarest term."""
    u, q = _units(spark, d), _queries(spark, d)
    held = R.postings(u).select("unit_id", "term").distinct()
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    parts = q.select("qid", F.posexplode(F.slice(F.split("query", ",", -1), 1, 3)).alias("facet", "part"))
    terms = parts.select("qid", "facet", F.explode(F.array_distinct(text.tokens(F.col("part")))).alias("term"))
    rare = terms.join(df, "term").groupBy("qid", "facet").agg(F.min(F.struct("df", "term"))["term"].alias("term"))
    covered = rare.join(held, "term").groupBy("qid", "unit_id").agg(F.countDistinct("facet").alias("covered"))
    t = R.top(R.bm25f(u, q), 50).join(covered, ["qid", "unit_id"], "left")
    bonus = F.least(0.5 * (F.greatest(F.coalesce("covered", F.lit(0)), F.lit(1)) - 1), F.lit(1.0)) / (scoring.RRF_K + F.col("rank"))
    return t.select("qid", "unit_id", F.round(scoring.rrf(F.lit(1.0), F.col("rank")) + bonus, 9).alias("score"))


@query("merged_edges", """WITH s AS (SELECT conv_id, conv_id * 4294967296 + turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
e AS (SELECT a.id AS src, b.id AS dst, 0.8::DOUBLE AS w FROM s a JOIN s b USING (conv_id) WHERE b.pos - a.pos = 1
UNION ALL SELECT a.id, b.id, 0.3::DOUBLE FROM s a JOIN s b USING (conv_id) WHERE b.pos - a.pos BETWEEN 1 AND 4)
SELECT src, dst, round(sum(w), 6) AS weight, count(*) AS kinds FROM e GROUP BY 1, 2""")
def merged_edges(spark, d):
    """Adjacent and same-session edges of type weights 0.8 and 0.3; duplicates add."""
    w = W.partitionBy("conv_id").orderBy("turn")
    u = load(spark, d, "conversations").withColumn("id", F.col("conv_id") * 4294967296 + F.col("turn"))
    near = F.array(*[F.struct(F.lead("id", k).over(w).alias("dst"), F.lit(x).alias("w")) for k, x in ((1, 0.8), (1, 0.3), (2, 0.3), (3, 0.3), (4, 0.3))])
    e = u.select(F.col("id").alias("src"), near.alias("n")).select("src", F.explode("n").alias("n")).where("n.dst is not null")
    return e.groupBy("src", F.col("n.dst").alias("dst")).agg(F.round(F.sum("n.w"), 6).alias("weight"), F.count(F.lit(1)).alias("kinds"))


@query("identifier_equivalence", r"""WITH v AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, 'https?://[A-Za-z0-9./_?=&%#-]+')) FROM pages),
k AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '[/.#?]+$', '') AS key FROM v)
SELECT key, count(DISTINCT page_id) AS pages, min(page_id) AS first FROM k GROUP BY 1""")
def identifier_equivalence(spark, d):
    """URLs that differ in scheme, www or trailing marks share a key."""
    p = load(spark, d, "pages").select("page_id", "url", "html")
    inner = F.regexp_extract_all("html", F.lit(r"https?://[A-Za-z0-9./_?=&%#-]+"), F.lit(0))
    v = p.select("page_id", F.explode(F.concat(F.array("url"), inner)).alias("url"))
    k = v.select("page_id", F.regexp_replace(F.regexp_replace(F.lower("url"), r"^https?://(www\.)?", ""), r"[/.#?]+$", "").alias("key"))
    return k.groupBy("key").agg(F.countDistinct("page_id").alias("pages"), F.min("page_id").alias("first"))
