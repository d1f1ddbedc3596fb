"""Registered identifier, scope, source and feature lanes, and entity linking."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import scoring, text
from loomwork.operators import entities, retrieval as R, temporal
from loomwork.plans import lanes
from loomwork.plans.lanes import COV
from loomwork.plans.registry import load, query
from loomwork.plans.retrieval import BM, _queries, _units, tok

# Every pair of neighbouring words of a benchmark item is a known name, and so is each third single word.
NAMES = f"""w AS (SELECT {tok('text')} AS w FROM benchmark), i AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w),
names AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS canon FROM i WHERE i < len(w) UNION SELECT DISTINCT w[i] FROM i WHERE i % 3 = 1)"""


def _names(spark, d):
    w = load(spark, d, "benchmark").select(text.tokens(F.col("text")).alias("w"))
    i = w.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i")).where(F.size("w") > 0)
    pair = i.where(F.col("i") < F.size("w")).select(F.array_join(F.slice("w", F.col("i"), F.lit(2)), " ").alias("canon"))
    return pair.union(i.where("i % 3 = 1").select(F.element_at("w", F.col("i")).alias("canon"))).distinct()


@query("query_linking", f"""WITH RECURSIVE {NAMES}, q AS (SELECT conv_id * 4294967296 + turn AS qid, {tok('text')} AS w FROM conversations WHERE conv_id % 20 = 0),
g AS (SELECT qid, i::INTEGER AS start, n::INTEGER AS n, array_to_string(w[i:i + n - 1], ' ') AS canon FROM (SELECT qid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM q, (VALUES (1), (2), (3), (4)) v(n) WHERE len(w) >= n)),
h AS (SELECT * FROM g WHERE canon IN (SELECT canon FROM names)),
b AS (SELECT qid, start, max(n) AS n, arg_max(canon, n) AS canon FROM h GROUP BY 1, 2),
t AS (SELECT qid, start, n, canon FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY start) AS r FROM b) WHERE r = 1
 UNION ALL SELECT x.qid, x.start, x.n, x.canon FROM (SELECT b.*, row_number() OVER (PARTITION BY b.qid ORDER BY b.start) AS r FROM t JOIN b ON b.qid = t.qid AND b.start >= t.start + t.n) x WHERE r = 1)
SELECT qid, start, canon FROM t""")
def query_linking(spark, d):
    q = load(spark, d, "conversations").where("conv_id % 20 = 0").select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("qid"), F.col("text").alias("query"))
    return entities.link(q, _names(spark, d))


@query("alias_subsets", f"""WITH {NAMES}, n AS (SELECT canon, list_distinct(string_split(canon, ' ')) AS w FROM names),
p AS (SELECT a.canon AS alias, c.canon FROM n a, n c WHERE a.canon <> c.canon AND len(a.w) < len(c.w) AND list_has_all(c.w, a.w))
SELECT alias, canon, count(*) OVER (PARTITION BY alias) AS candidates, CASE WHEN count(*) OVER (PARTITION BY alias) = 1 THEN 'active' ELSE 'candidate' END AS status FROM p""")
def alias_subsets(spark, d):
    return entities.subset_aliases(_names(spark, d))


@query("alias_initials", f"""WITH {NAMES}, n AS (SELECT canon, split_part(canon, ' ', 1) || ' ' || split_part(canon, ' ', 2)[1] AS alias FROM names WHERE len(string_split(canon, ' ')) = 2),
s AS (SELECT canon FROM names UNION SELECT alias FROM n) SELECT DISTINCT alias, n.canon FROM n WHERE alias <> canon""")
def alias_initials(spark, d):
    n = _names(spark, d)
    two = n.where(F.size(F.split("canon", " ")) == 2)
    short = two.select(F.concat(F.split_part("canon", F.lit(" "), F.lit(1)), F.lit(" "), F.substring(F.split_part("canon", F.lit(" "), F.lit(2)), 1, 1)).alias("canon"))
    return entities.initial_aliases(n.union(short))


@query("exact_id_lane", """WITH k AS (SELECT event_id::VARCHAR AS needle, user_id FROM events WHERE event_type = 'signup' AND event_id % 3 = 0)
SELECT needle, e.event_id, CASE WHEN e.event_id::VARCHAR = needle THEN 1 ELSE 2 END AS tier FROM k JOIN events e ON e.user_id = k.user_id AND (e.event_id::VARCHAR = needle OR contains(e.props, '"k": ' || needle))""")
def exact_id_lane(spark, d):
    """Direct id lookups lead, then rows whose payload holds the id; both within the asker's scope."""
    e = load(spark, d, "events")
    k = e.where("event_type = 'signup' and event_id % 3 = 0").select(F.col("event_id").cast("string").alias("needle"), "user_id")
    x = e.select("event_id", "user_id", "props").join(k, "user_id")
    own = F.col("event_id").cast("string") == F.col("needle")
    hit = x.where(own | F.contains("props", F.concat(F.lit('"k": '), F.col("needle"))))
    return hit.select("needle", "event_id", F.when(own, 1).otherwise(2).alias("tier"))


@query("scope_lane", "SELECT conv_id * 4294967296 + turn AS unit_id, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS rank FROM conversations WHERE role = 'user' QUALIFY rank <= 200")
def scope_lane(spark, d):
    """All units of one speaker, newest first, up to the lane's pool of 200."""
    u = load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn").orderBy(F.desc("conv_id"), F.desc("turn")).limit(200)
    r = F.row_number().over(W.orderBy(F.desc("conv_id"), F.desc("turn"))).cast("long")
    return u.select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("unit_id"), r.alias("rank"))


@query("source_lane", f"""WITH s AS (SELECT page_id AS id, {tok("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS w FROM pages), n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avglen FROM s),
q AS (SELECT item_id AS qid, text AS query FROM benchmark WHERE item_id % 5 = 0), qt AS (SELECT DISTINCT qid, unnest({tok('query')}) AS term FROM q),
p AS (SELECT id, term, len(w) AS len, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM s) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
sc AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), n GROUP BY 1, 2)
SELECT qid, id AS page_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 20""")
def source_lane(spark, d):
    """Single-field BM25 over raw sources: pages without their tags."""
    s = load(spark, d, "pages").select("page_id", text.tokens(F.regexp_replace("html", "<[^>]*>", " ")).alias("w"))
    n = s.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.size("w")) / F.count(F.lit(1))).alias("avglen"))
    terms = R.query_terms(_queries(spark, d))
    asked = terms.select("term").distinct()
    p = s.select("page_id", F.size("w").alias("len"), F.explode("w").alias("term")).join(asked, "term", "left_semi").groupBy("page_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = terms.join(p, "term").join(df, "term").join(F.broadcast(n))  # one row
    part = scoring.idf(F.col("n"), F.col("df")) * F.col("tf") * (scoring.K1 + 1) / (F.col("tf") + scoring.K1 * (0.25 + 0.75 * F.col("len") / F.col("avglen")))
    sc = x.groupBy("qid", "page_id").agg(F.round(F.sum(part), 6).alias("score"))
    r = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "page_id"))
    return sc.withColumn("r", r).where("r <= 20").select("qid", "page_id", "score")


@query("feature_rerank", f"""WITH {COV}, t AS (SELECT bm.*, cov_idf, 1.0::DOUBLE / (60 + rank) AS rrf FROM bm JOIN cov USING (qid, unit_id)), m AS (SELECT qid, max(rrf) AS top FROM t GROUP BY 1),
w AS (SELECT qid, {tok('query')} AS qw FROM q),
a AS (SELECT qid, CASE WHEN list_contains(qw, 'user') AND NOT list_contains(qw, 'assistant') THEN 'user' WHEN list_contains(qw, 'assistant') AND NOT list_contains(qw, 'user') THEN 'assistant' END AS asked, qw FROM w),
fr AS (SELECT t.qid, unit_id, round(rrf / top + 0.9 * cov_idf + 0.3 * CASE WHEN contains(' ' || array_to_string({tok('u.text')}, ' ') || ' ', ' ' || array_to_string(qw[1:2], ' ') || ' ') THEN 1 ELSE 0 END
  + 0.4 * CASE WHEN asked IS NULL OR speaker IS NULL THEN 0.5 WHEN speaker = asked THEN 1.0 ELSE 0.0 END + 0.4 * 0.5, 6)::DOUBLE AS score FROM t JOIN m USING (qid) JOIN u USING (unit_id) JOIN a USING (qid))
SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM fr""")
def feature_rerank(spark, d):
    """Fused rank, covered idf, phrase, speaker match and time, weighted and re-ranked; what is unknown is neutral."""
    u, q = _units(spark, d), _queries(spark, d)
    t = lanes.coverage(spark, d).withColumn("rrf", scoring.rrf(F.lit(1.0), F.col("rank")))
    t = t.withColumn("top", F.max("rrf").over(W.partitionBy("qid"))).join(u.select("unit_id", "speaker", "text"), "unit_id").join(q, "qid")
    words, pad = text.tokens(F.col("query")), lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    user, other = F.array_contains(words, "user"), F.array_contains(words, "assistant")
    t = t.withColumn("asked", F.when(user & ~other, "user").when(other & ~user, "assistant"))
    phrase = F.contains(pad(text.tokens(F.col("text"))), pad(F.slice(words, 1, 2))).cast("int")
    match = F.when(F.col("asked").isNull() | F.col("speaker").isNull(), 0.5).when(F.col("speaker") == F.col("asked"), 1.0).otherwise(0.0)
    f = t.select("qid", "unit_id", F.round(F.col("rrf") / F.col("top") + 0.9 * F.col("cov_idf") + 0.3 * phrase + 0.4 * match + 0.4 * 0.5, 6).alias("score"))
    return f.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "unit_id")).cast("long"))


@query("when_tokens", """SELECT event_id, lower(strftime(ts, '%A')) || ' ' || lower(strftime(ts, '%B')) || ' ' || strftime(ts, '%Y') AS tokens FROM events""")
def when_tokens(spark, d):
    return load(spark, d, "events").select("event_id", F.lower(F.date_format("ts", "EEEE MMMM yyyy")).alias("tokens"))


@query("vector_validation", """SELECT vec_id, embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0 AS valid FROM embeddings""")
def vector_validation(spark, d):
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return load(spark, d, "embeddings").select("vec_id", F.coalesce((F.size("embedding") == 64) & fine & (norm > 0), F.lit(False)).alias("valid"))


@query("interval_algebra", """WITH i AS (SELECT user_id, epoch_us(min(ts)) AS s1, epoch_us(max(ts)) AS e1, 1705276800000000 AS s2, CASE WHEN user_id % 4 > 0 THEN 1705881600000000 END AS e2 FROM events GROUP BY 1)
SELECT user_id, greatest(s1, s2) AS cut_from, least(e1, coalesce(e2, e1)) AS cut_to, least(s1, s2) AS span_from, CASE WHEN e2 IS NOT NULL THEN greatest(e1, e2) END AS span_to, (s1 + e1) // 2 AS mid, (e1 - s1) / 3600000000 AS hours FROM i WHERE greatest(s1, s2) < least(e1, coalesce(e2, e1))""")
def interval_algebra(spark, d):
    """Cut, span, floor midpoint and length of user activity against a window, open at its end for some users."""
    us = temporal.micros(F.col("ts"))
    i = load(spark, d, "events").groupBy("user_id").agg(F.min(us).alias("s1"), F.max(us).alias("e1"))
    s2, e2 = F.lit(1705276800000000), F.when(F.col("user_id") % 4 > 0, F.lit(1705881600000000))
    lo, hi = F.greatest("s1", s2), F.least(F.col("e1"), e2)  # least skips an open bound
    out = i.select("user_id", lo.alias("cut_from"), hi.alias("cut_to"), F.least("s1", s2).alias("span_from"), F.when(e2.isNotNull(), F.greatest(F.col("e1"), e2)).alias("span_to"),
                   F.expr("(s1 + e1) div 2").alias("mid"), ((F.col("e1") - F.col("s1")) / 3600000000).alias("hours"))
    return out.where("cut_from < cut_to")


@query("age_at_date", """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS birth FROM orders) SELECT birth, year(DATE '2024-02-29') - year(birth) - CASE WHEN (month(birth), day(birth)) > (2, 29) THEN 1 ELSE 0 END AS years,
CASE WHEN month(birth) IN (12, 1, 2) THEN 'winter' WHEN month(birth) <= 5 THEN 'spring' WHEN month(birth) <= 8 THEN 'summer' ELSE 'autumn' END AS season, strftime(birth, '%Y-%m') AS shown FROM d""")
def age_at_date(spark, d):
    """Whole years at a day, by month and day so that leap days hold; season; a label no sharper than the month."""
    b = load(spark, d, "orders").select(F.to_date("o_orderdate").alias("birth")).distinct()
    m, day = F.month("birth"), F.dayofmonth("birth")
    late = (m > 2) | ((m == 2) & (day > 29))
    season = F.when(m.isin(12, 1, 2), "winter").when(m <= 5, "spring").when(m <= 8, "summer").otherwise("autumn")
    return b.select("birth", (F.lit(2024) - F.year("birth") - late.cast("int")).cast("long").alias("years"), season.alias("season"), F.date_format("birth", "yyyy-MM").alias("shown"))
