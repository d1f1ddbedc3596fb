"""Registered retrieval queries: index, statistics, lanes, fusion, context."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import scoring
from loomwork.functions.text import MARKED, MENTION, PLAIN, mentions
from loomwork.operators import retrieval as R
from loomwork.operators.nearest import cosine_nearest
from loomwork.plans.registry import load, query

FOLD = f"translate(lower({{}}), '{MARKED}', '{PLAIN}')"
TOK = f"regexp_extract_all({FOLD}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


def tok(expr: str) -> str:
    return TOK.format(f"coalesce({expr}, '')").replace("{{", "{").replace("}}", "}")


UNITS = "u AS (SELECT conv_id * 4294967296 + turn AS unit_id, conv_id AS session_id, turn AS seq, role AS speaker, text FROM conversations)"
STATED = "q AS (SELECT item_id AS qid, text AS query FROM benchmark WHERE item_id % 5 = 0)"
SOURCES = {"text": "text", "entities": f"array_to_string(regexp_extract_all(text, '{MENTION}'), ' ')", "speaker": "speaker", "session": "'conv' || session_id", "when": "strftime(stamp, '%Y %B %-d %A')"}
# the model's published field weights and length norms, stated again for the SQL side
WEIGHT = "CASE p.field WHEN 'text' THEN 1.0::DOUBLE WHEN 'entities' THEN 0.8::DOUBLE WHEN 'when' THEN 0.6::DOUBLE WHEN 'speaker' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END"
NORM = "CASE p.field WHEN 'text' THEN 0.75::DOUBLE WHEN 'entities' THEN 0.3::DOUBLE WHEN 'session' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"


def postings_sql(units: str = UNITS, queries: str = STATED, fields: tuple = ("text", "entities", "speaker", "session")) -> str:
    each = "\n      UNION ALL ".join(f"SELECT unit_id, '{f}' AS field, {tok(SOURCES[f])} AS w FROM u" for f in fields)
    return f"""{units},
f AS ({each}),
p AS (SELECT unit_id, field, term, len(w) AS len, count(*) AS tf FROM (SELECT unit_id, field, w, unnest(w) AS term FROM f) GROUP BY ALL),
st AS (SELECT field, count(*) AS n_units, sum(len(w))::BIGINT AS total_len FROM f GROUP BY 1),
{queries},
qt AS (SELECT DISTINCT qid, unnest({tok('query')}) AS term FROM q)"""


def ranked_sql(postings: str) -> str:
    return f"""{postings},
df AS (SELECT term, count(DISTINCT unit_id) AS df FROM p GROUP BY 1),
part AS (SELECT qid, unit_id, p.term, sum({WEIGHT} * tf / (1 - {NORM} + {NORM} * len / (total_len / n_units))) AS tf, min(n_units) AS n
  FROM p JOIN qt ON p.term = qt.term JOIN st ON p.field = st.field GROUP BY 1, 2, 3),
sc AS (SELECT qid, unit_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)), 6) AS score FROM part JOIN df USING (term) GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM sc)"""


POSTINGS = postings_sql()
BM = ranked_sql(POSTINGS)


def _units(spark, d):
    return R.units(load(spark, d, "conversations"))


def _queries(spark, d):
    """The stated query set: benchmark items with an id divisible by five."""
    return load(spark, d, "benchmark").where("item_id % 5 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query("search_bm25f", f"WITH {BM} SELECT qid, unit_id, score, rank FROM bm WHERE rank <= 10")
def search_bm25f(spark, d):
    out = R.top(R.bm25f(_units(spark, d), _queries(spark, d)), 10)
    return out.select("qid", "unit_id", "score", F.col("rank").cast("long").alias("rank"))


@query("corpus_statistics", f"WITH {POSTINGS} SELECT field, n_units, total_len FROM st")
def corpus_statistics(spark, d):
    return R.statistics(_units(spark, d))


@query("document_frequency", f"WITH {POSTINGS} SELECT field, term, count(*) AS df FROM p GROUP BY 1, 2")
def document_frequency(spark, d):
    return R.document_frequency(R.postings(_units(spark, d)))


@query("inverted_index", f"WITH {POSTINGS} SELECT unit_id, field, term, tf, len::BIGINT AS len FROM p")
def inverted_index(spark, d):
    return R.postings(_units(spark, d)).withColumn("len", F.col("len").cast("long")).select("unit_id", "field", "term", "tf", "len")


NOM = f"""{POSTINGS}, df AS (SELECT term, count(DISTINCT unit_id) AS df FROM p GROUP BY 1),
nom AS (SELECT qid, term, df FROM (SELECT qid, qt.term, df, row_number() OVER (PARTITION BY qid ORDER BY df, qt.term) AS r FROM qt JOIN df ON qt.term = df.term)
        WHERE (df <= 200 OR r = 1) AND r <= 32)"""


@query("term_nomination", f"WITH {NOM} SELECT qid, term, df FROM nom")
def term_nomination(spark, d):
    p = R.postings(_units(spark, d))
    return R.nominate(R.query_terms(_queries(spark, d)), R.document_frequency(p, by_field=False), floor=200)


@query(
    "cooccurrence_filter",
    f"""WITH {NOM}, h AS (SELECT qid, unit_id, count(*) AS n_terms, min(df) AS low FROM (SELECT DISTINCT unit_id, term FROM p) JOIN nom USING (term) GROUP BY 1, 2)
SELECT qid, unit_id, n_terms FROM h WHERE n_terms >= 2 OR low < 4""",
)
def cooccurrence_filter(spark, d):
    p = R.postings(_units(spark, d))
    return R.cooccurring(p, R.nominate(R.query_terms(_queries(spark, d)), R.document_frequency(p, by_field=False), floor=200))


FUSE = f"""{BM}, lex AS (SELECT qid, unit_id, rank FROM bm WHERE rank <= 50),
cov AS (SELECT qid, unit_id, count(*) AS score FROM (SELECT DISTINCT unit_id, term FROM p WHERE field = 'text') JOIN qt USING (term) GROUP BY 1, 2),
cr AS (SELECT qid, unit_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM cov),
fused AS (SELECT qid, unit_id, round(sum(w / (60 + rank)), 9) AS rrf, count(*) AS n_lanes FROM (
  SELECT qid, unit_id, rank, 1.0::DOUBLE AS w FROM lex UNION ALL SELECT qid, unit_id, rank, 0.5::DOUBLE FROM cr WHERE rank <= 50) GROUP BY 1, 2)"""


@query("rrf_fusion", f"WITH {FUSE} SELECT qid, unit_id, rrf, n_lanes FROM fused")
def rrf_fusion(spark, d):
    u, q = _units(spark, d), _queries(spark, d)
    lexical = R.top(R.bm25f(u, q), 50)
    p = R.postings(u, ["text"]).select("unit_id", "term").distinct()
    coverage = p.join(R.query_terms(q), "term").groupBy("qid", "unit_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    out = R.fuse({"lexical": (lexical, 1.0), "coverage": (R.top(coverage, 50), 0.5)})
    return out.withColumn("rrf", F.round("rrf", 9))


POS = f"pos AS (SELECT unit_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, unit_id) AS pos FROM u)"


@query(
    "neighbour_attach",
    f"""WITH {BM}, {POS} SELECT b.qid, b.unit_id, n.unit_id AS near_unit, (n.pos - a.pos)::INTEGER AS offset
FROM bm b JOIN pos a ON a.unit_id = b.unit_id JOIN pos n ON n.session_id = a.session_id AND abs(n.pos - a.pos) = 1 WHERE b.rank <= 10""",
)
def neighbour_attach(spark, d):
    u = _units(spark, d)
    return R.neighbours(R.top(R.bm25f(u, _queries(spark, d)), 10), u)


@query(
    "context_propagation",
    f"""WITH {BM}, {POS}, t AS (SELECT qid, unit_id, score FROM bm WHERE rank <= 50)
SELECT qid, unit_id, round(max(score) + 3e-8, 4)::DOUBLE AS score FROM (SELECT * FROM t UNION ALL
SELECT t.qid, n.unit_id, t.score * 0.7::DOUBLE FROM t JOIN pos a ON a.unit_id = t.unit_id JOIN pos n ON n.session_id = a.session_id AND abs(n.pos - a.pos) = 1) GROUP BY 1, 2""",
)
def context_propagation(spark, d):
    u = _units(spark, d)
    return R.propagate(R.top(R.bm25f(u, _queries(spark, d)), 50), u).withColumn("score", F.round(F.col("score") + 3e-8, 4))  # off exact ties, which engines round differently


@query("session_max_pool", f"WITH {BM} SELECT qid, session_id, max(score) AS score, count(*) AS n_units FROM bm JOIN u USING (unit_id) GROUP BY 1, 2")
def session_max_pool(spark, d):
    u = _units(spark, d)
    s = R.bm25f(u, _queries(spark, d)).withColumn("score", F.round("score", 6))
    return s.join(u.select("unit_id", "session_id"), "unit_id").groupBy("qid", "session_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_units"))


@query(
    "fuzzy_respelling",
    f"""WITH {POSTINGS}, v AS (SELECT DISTINCT term AS near FROM p WHERE field = 'text'),
t AS (SELECT DISTINCT qid, term[2:] AS term FROM qt WHERE len(term) > 4),
c AS (SELECT term, near, levenshtein(term, near) AS distance FROM (SELECT DISTINCT term FROM t WHERE term NOT IN (SELECT near FROM v)) JOIN v
      ON abs(len(term) - len(near)) <= 2 WHERE levenshtein(term, near) <= CASE WHEN len(term) <= 5 THEN 1 ELSE 2 END),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY distance, near) AS r FROM c)
SELECT qid, term, near, distance FROM t JOIN r USING (term) WHERE r <= 8""",
)
def fuzzy_respelling(spark, d):
    """Query terms that lost their first letter, respelled from the vocabulary."""
    terms = R.query_terms(_queries(spark, d)).where("length(term) > 4").select("qid", F.expr("substring(term, 2)").alias("term")).distinct()
    vocabulary = R.postings(_units(spark, d), ["text"]).select("term").distinct()
    out = R.fuzzy_terms(terms, vocabulary)
    return out.withColumn("distance", F.col("distance").cast("long"))


@query(
    "dense_lane",
    """WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id, round(list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> qid)
SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
)
def dense_lane(spark, d):
    """Exact cosine top-k of the stated queries (ids divisible by 20) over all rows, in blocks of both."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    s = cosine_nearest(e, e.where("vec_id % 20 = 0"), 10)
    return R.top(s, 10).select("qid", F.col("unit_id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(
    "int8_quantize",
    """WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM embeddings)
SELECT vec_id, round(scale, 9) AS scale, list_sum(list_transform(embedding, lambda x: round(x::DOUBLE / scale)))::BIGINT AS code_sum FROM s""",
)
def int8_quantize(spark, d):
    e = load(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    # not called scale: inside the lambda that name would be the rounded column of the same select
    e = e.withColumn("step", F.array_max(F.transform("v", F.abs)) / 127)
    codes = F.transform("v", lambda x: F.round(x / F.col("step")))
    return e.select("vec_id", F.round("step", 9).alias("scale"), F.aggregate(codes, F.lit(0.0), lambda a, x: a + x).cast("long").alias("code_sum"))


@query(
    "rank_boosts",
    f"""WITH {BM}, n AS (SELECT qid, unit_id, rank, count(*) OVER (PARTITION BY qid) AS n, (SELECT max(session_id) FROM u) AS last, session_id, len(regexp_extract_all(text, '{MENTION}')) AS names FROM bm JOIN u USING (unit_id) WHERE rank <= 20)
SELECT qid, unit_id, round(CASE WHEN n > 1 THEN 1 - 0.9 * (rank - 1) / (n - 1) ELSE 1 END * least(greatest((1 + 0.2 * (session_id::DOUBLE / last - 0.5)) * (1 + 0.1 * (least(1, 0.5 + ln(1 + names) / 10) - 0.5)), 0.75), 1.3), 6)::DOUBLE AS boosted FROM n""",
)
def rank_boosts(spark, d):
    """Rank-scaled base times bounded boosts: later sessions are more recent, proof is the names a unit holds, no window is neutral."""
    u = _units(spark, d)
    last = u.agg(F.max("session_id").alias("last"))  # one row
    t = R.top(R.bm25f(u, _queries(spark, d)), 20).join(u.select("unit_id", "session_id", F.size(mentions(F.col("text"))).alias("names")), "unit_id").join(F.broadcast(last))
    base = 1 - 0.9 * F.percent_rank().over(W.partitionBy("qid").orderBy("rank"))
    proof = F.least(F.lit(1.0), 0.5 + F.log(1.0 + F.col("names")) / 10)
    b = scoring.boost(F.col("session_id") / F.col("last"), F.lit(0.5), proof)
    return t.withColumn("base", base).select("qid", "unit_id", F.round(F.col("base") * b, 6).alias("boosted"))


@query("indexed_search", f"WITH {BM} SELECT qid, unit_id, score, rank FROM bm WHERE rank <= 10")
def indexed_search(spark, d):
    """The flagship's results from a stored index: built in two generations, the second replacing some units of the first."""
    from loomwork.engine import Engine
    from loomwork.scratch import Scratch

    e, u = Engine(spark, Scratch(spark, "index").path("store")), _units(spark, d)
    draft = F.when(F.col("session_id") % 4 == 0, F.lit("draft to be replaced")).otherwise(F.col("text"))
    e.ingest(u.where("session_id % 3 <> 0").withColumn("text", draft))
    e.ingest(u.where("session_id % 3 = 0 or session_id % 4 = 0"))
    return e.search(_queries(spark, d), 10).select("qid", "unit_id", "score", F.col("rank").cast("long").alias("rank"))


AT = "TIMESTAMP '2024-01-01' + to_days((conv_id * 3)::INTEGER) AS stamp"
ASKED = "(1, 'what happened on monday 4 march'), (2, 'user in april 2024'), (3, 'Le la sunday'), (4, 'conv3 friday')"
DATED = ranked_sql(postings_sql(UNITS.replace("text FROM", f"text, {AT} FROM"), f"q AS (SELECT * FROM (VALUES {ASKED}) AS v(qid, query))", tuple(R.DATED)))


@query("dated_search", f"WITH {DATED} SELECT qid, unit_id, score, rank FROM bm WHERE rank <= 20")
def dated_search(spark, d):
    """All five fields: text, names, speaker, session and the words of the unit's time."""
    u = _units(spark, d).withColumn("at", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(session_id * 3 as int))"))
    q = spark.sql(f"SELECT CAST(qid AS BIGINT) AS qid, query FROM VALUES {ASKED} AS v(qid, query)")
    out = R.top(R.bm25f(u, q, R.DATED), 20)
    return out.select(F.col("qid").cast("int").alias("qid"), "unit_id", "score", F.col("rank").cast("long").alias("rank"))
