"""Registered queries on evidence: signals, seeds, support labels, computed answers, updates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import intervals, text
from loomwork.operators import answers as A, retrieval as R
from loomwork.plans.lanes import ENT, _mentions
from loomwork.plans.registry import load, query
from loomwork.plans.retrieval import BM, _queries, _units, tok


def rows(spark, values: str, columns: str):
    """A stated table; the SQL side reads the same rows."""
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    cast = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", "))
    return spark.sql(f"SELECT {cast} FROM VALUES {values} AS v({names})")


def _ranked(spark, d, k=40):
    return R.top(R.bm25f(_units(spark, d), _queries(spark, d)), k)


@query("facet_reservation", f"""WITH {BM}, t AS (SELECT qid, unit_id, rank, list_contains({tok('u.text')}, list_last({tok('q.query')})) AS tagged FROM bm JOIN u USING (unit_id) JOIN q USING (qid) WHERE rank <= 40),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, tagged ORDER BY rank) AS own FROM t),
h AS (SELECT qid, unit_id, row_number() OVER (PARTITION BY qid ORDER BY (tagged AND own <= 5) DESC, rank) AS o FROM o) SELECT qid, unit_id FROM h WHERE o <= 10""")
def facet_reservation(spark, d):
    """Ten slots a query, half of them kept for units that hold its last term."""
    t = _ranked(spark, d).join(_units(spark, d).select("unit_id", "text"), "unit_id").join(_queries(spark, d), "qid")
    tagged = F.array_contains(text.tokens(F.col("text")), F.element_at(text.tokens(F.col("query")), -1))
    return A.reserve(t.select("qid", "unit_id", "rank", tagged.alias("tagged")), 10)


@query("lex_anchor", f"""WITH {BM} SELECT qid, unit_id, round(1.0 / (60 + rank) + CASE WHEN rank <= 3 THEN 1 / (60 + rank / 2.0) ELSE 0 END, 9)::DOUBLE AS score FROM bm WHERE rank <= 20""")
def lex_anchor(spark, d):
    """Reciprocal rank with the anchor of the first three lexical ranks."""
    r = F.col("rank").cast("double")
    return _ranked(spark, d, 20).select("qid", "unit_id", F.round(1 / (60 + r) + F.when(r <= 3, 1 / (60 + r / 2)).otherwise(0.0), 9).alias("score"))


@query("combsum_form", f"""WITH {BM}, n AS (SELECT qid, unit_id, score / max(score) OVER (PARTITION BY qid) AS s FROM bm WHERE rank <= 20),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT qid, unit_id, s, coalesce(list_cosine_similarity(a.e, b.e), 0) AS cos FROM n LEFT JOIN v a ON a.vec_id = qid LEFT JOIN v b ON b.vec_id = unit_id // 4294967296)
SELECT qid, unit_id, round(s + 1.2 * cos, 6)::DOUBLE AS score FROM c""")
def combsum_form(spark, d):
    """Normalised lexical score plus 1.2 times the cosine of the query's and the conversation's vectors (0 without one)."""
    from loomwork.functions import scoring

    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    n = _ranked(spark, d, 20).withColumn("s", F.col("score") / F.max("score").over(W.partitionBy("qid")))
    n = n.withColumn("conv", F.expr("unit_id div 4294967296"))
    n = n.join(v.toDF("a_id", "a"), F.col("a_id") == F.col("qid"), "left").join(v.toDF("b_id", "b"), F.col("b_id") == F.col("conv"), "left")
    cos = F.coalesce(F.aggregate(F.zip_with(F.col("a").cast("array<double>"), F.col("b").cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda p, x: p + x)
                     / (F.sqrt(F.aggregate(F.col("a").cast("array<double>"), F.lit(0.0), lambda p, x: p + x * x)) * F.sqrt(F.aggregate(F.col("b").cast("array<double>"), F.lit(0.0), lambda p, x: p + x * x))), F.lit(0.0))
    return n.select("qid", "unit_id", F.round(F.col("s") + 1.2 * cos, 6).alias("score"))


@query("bounded_priors", """WITH w AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), p AS (SELECT user_id, count(*) AS proof FROM events GROUP BY 1)
SELECT event_id, round(value * (1 + 0.1 * (2 * (epoch_us(ts) - epoch_us(lo))::DOUBLE / (epoch_us(hi) - epoch_us(lo)) - 1)) * CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' THEN 1.1 ELSE 1 END
 * (1 + least(0.05, ln(proof) / 100)), 6)::DOUBLE AS score FROM events JOIN p USING (user_id), w""")
def bounded_priors(spark, d):
    """Base score with priors of a bounded share: recency 10 % either way, 10 % within the window, proof 5 % at most."""
    e = load(spark, d, "events")
    w = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))  # one row
    p = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("proof"))
    us = F.unix_micros
    e = e.withColumn("ts", F.col("ts").cast("timestamp")).join(p, "user_id").join(F.broadcast(w.select(F.col("lo").cast("timestamp").alias("lo"), F.col("hi").cast("timestamp").alias("hi"))))
    recent = 1 + 0.1 * (2 * (us("ts") - us("lo")) / (us("hi") - us("lo")) - 1)
    covered = F.when((F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-12"), 1.1).otherwise(1.0)
    proof = 1 + F.least(F.lit(0.05), F.log(F.col("proof").cast("double")) / 100)
    return e.select("event_id", F.round(F.col("value") * recent * covered * proof, 6).alias("score"))


WEIGHTS = "('1-URGENT', 'price', 0.7), ('1-URGENT', 'age', 0.3), ('2-HIGH', 'price', 0.4), ('2-HIGH', 'age', 0.6), ('3-MEDIUM', 'age', 1.0)"


@query("weighted_signals", f"""WITH w AS (SELECT * FROM (VALUES {WEIGHTS}) AS v(class, signal, w)), m AS (SELECT max(o_totalprice) AS p, max(o_orderkey) AS k FROM orders),
s AS (SELECT o_orderkey, o_custkey, o_orderpriority AS class, 'price' AS signal, o_totalprice / p AS x FROM orders, m UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority, 'age', o_orderkey::DOUBLE / k FROM orders, m),
t AS (SELECT class, o_custkey, o_orderkey, round(sum(w * x), 6)::DOUBLE AS score FROM s JOIN w USING (class, signal) GROUP BY 1, 2, 3)
SELECT class, o_orderkey, score, row_number() OVER (PARTITION BY class ORDER BY score DESC, o_custkey, o_orderkey DESC) AS rank FROM t QUALIFY rank <= 20""")
def weighted_signals(spark, d):
    """The weighted sum of a class's signals; ties by source, newest first."""
    o = load(spark, d, "orders")
    m = o.agg(F.max("o_totalprice").alias("p"), F.max("o_orderkey").alias("k"))  # one row
    both = F.array(F.struct(F.lit("price").alias("signal"), (F.col("o_totalprice") / F.col("p")).alias("x")), F.struct(F.lit("age").alias("signal"), (F.col("o_orderkey") / F.col("k")).alias("x")))
    s = o.join(F.broadcast(m)).select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("class"), F.explode(both).alias("y")).select("o_orderkey", "o_custkey", "class", "y.*")
    w = F.broadcast(rows(spark, WEIGHTS, "class STRING, signal STRING, w DOUBLE"))  # a table of weights
    t = s.join(w, ["class", "signal"]).groupBy("class", "o_custkey", "o_orderkey").agg(F.round(F.sum(F.col("w") * F.col("x")), 6).alias("score"))
    r = F.row_number().over(W.partitionBy("class").orderBy(F.desc("score"), "o_custkey", F.desc("o_orderkey")))
    return t.withColumn("rank", r).where("rank <= 20").select("class", "o_orderkey", "score", F.col("rank").cast("long").alias("rank"))


@query("union_of_signals", """WITH e AS (SELECT user_id, event_type, CASE WHEN value >= 30 THEN event_id END AS fact, [props, event_type] AS members, value FROM events),
f AS (SELECT user_id, arg_min(fact, event_type || fact) AS fact FROM (SELECT user_id, event_type, min(fact) AS fact FROM e WHERE fact IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT user_id, max(value) AS feature FROM e GROUP BY 1), m AS (SELECT user_id, list_sort(list_distinct(flatten(list(members)))) AS members FROM e GROUP BY 1)
SELECT user_id, fact, len(members)::BIGINT AS members, members[1] AS first_member, feature FROM g LEFT JOIN f USING (user_id) JOIN m USING (user_id)""")
def union_of_signals(spark, d):
    """Lanes are event types: the first lane's fact, the union of members, the largest feature."""
    e = load(spark, d, "events").select("user_id", "event_type", F.when(F.col("value") >= 30, F.col("event_id")).alias("fact"), F.array("props", "event_type").alias("members"), "value")
    lanes = e.groupBy("user_id", "event_type").agg(F.min("fact").alias("fact"), F.array_distinct(F.flatten(F.collect_set("members"))).alias("members"), F.max("value").alias("value"))
    u = A.union_signals(lanes, "user_id", "event_type", "fact", "members", "value")
    return u.select("user_id", "fact", F.size("members").cast("long").alias("members"), F.col("members")[0].alias("first_member"), "feature")


@query("paged_results", """WITH a AS (SELECT event_id, value FROM events WHERE event_type = 'click'), c AS (SELECT value, event_id FROM a ORDER BY value DESC, event_id LIMIT 1 OFFSET 39)
SELECT a.event_id, a.value FROM a, c WHERE a.value < c.value OR (a.value = c.value AND a.event_id > c.event_id) ORDER BY a.value DESC, a.event_id LIMIT 20""")
def paged_results(spark, d):
    """The third page of twenty: rows after the last key of the page before."""
    a = load(spark, d, "events").where("event_type = 'click'").select("event_id", "value")
    order = [F.desc("value"), F.col("event_id")]
    last = a.orderBy(*order).limit(40).orderBy(F.asc("value"), F.desc("event_id")).limit(1).toDF("e0", "v0")  # one row
    return a.join(F.broadcast(last)).where("value < v0 or (value = v0 and event_id > e0)").orderBy(*order).limit(20).select("event_id", "value")


@query("canon_quota", f"""WITH {ENT}, q AS (SELECT DISTINCT item_id AS qid, lower(unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*'))) AS canon FROM benchmark),
h AS (SELECT qid, canon, unit_id, df FROM q JOIN m USING (canon) JOIN c USING (canon)), k AS (SELECT *, count(*) OVER (PARTITION BY qid, unit_id) AS hits FROM h),
s AS (SELECT *, row_number() OVER (PARTITION BY qid, canon ORDER BY df DESC, unit_id) AS r FROM k WHERE hits = 1) SELECT qid, unit_id FROM s WHERE r <= 3 UNION SELECT qid, unit_id FROM k WHERE hits > 1""")
def canon_quota(spark, d):
    """Three units a canon of a query, and every unit that two of its canons share."""
    m = _mentions(spark, d)
    df = m.groupBy("canon").agg(F.count(F.lit(1)).alias("score"))
    q = load(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0))).alias("s")).select("qid", F.lower("s").alias("canon")).distinct()
    return A.quota(q.join(m, "canon").join(df, "canon"), 3)


ALIASES = ", ".join(f"('{c}', '{c[0]}{i}', {str(i % 3 != 0).lower()})" for c in ("ann lee", "bob ray", "eve moor") for i in range(14))


@query("alias_expansion", f"""WITH a AS (SELECT * FROM (VALUES {ALIASES}) AS v(canon, alias, active)) SELECT canon, alias FROM (SELECT canon, alias, row_number() OVER (PARTITION BY canon ORDER BY alias) AS r FROM a WHERE active) WHERE r <= 8""")
def alias_expansion(spark, d):
    """Up to eight active aliases widen a canon; candidates never do."""
    a = rows(spark, ALIASES, "canon STRING, alias STRING, active BOOLEAN").where("active")
    return a.withColumn("r", F.row_number().over(W.partitionBy("canon").orderBy("alias"))).where("r <= 8").select("canon", "alias")


@query("speaker_resolution", "WITH q AS (SELECT * FROM (VALUES (1, 'user'), (1, 'paris'), (2, 'assistant'), (3, 'User'), (4, NULL)) AS v(qid, canon)) SELECT qid, lower(canon) AS canon FROM q WHERE lower(canon) IN (SELECT lower(role) FROM conversations)")
def speaker_resolution(spark, d):
    """Which canons of a query speak in the corpus."""
    q = rows(spark, "(1, 'user'), (1, 'paris'), (2, 'assistant'), (3, 'User'), (4, NULL)", "qid INT, canon STRING").withColumn("canon", F.lower("canon"))
    who = load(spark, d, "conversations").select(F.lower("role").alias("canon")).distinct()
    return q.join(who, "canon", "left_semi").select("qid", "canon")


@query("graph_seeds", f"""WITH {BM}, m AS (SELECT DISTINCT unit_id, lower(unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*'))) AS canon FROM u),
qe AS (SELECT DISTINCT qid, lower(unnest(regexp_extract_all(query, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*'))) AS canon FROM q),
e AS (SELECT qid, unit_id, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, unit_id) AS r FROM qe JOIN m USING (canon) GROUP BY qid, unit_id),
rare AS (SELECT qid, arg_min(term, (df, term)) AS term FROM qt JOIN df USING (term) GROUP BY 1),
x AS (SELECT qid, min(unit_id) AS unit_id FROM rare JOIN p USING (term) WHERE field = 'text' GROUP BY 1)
SELECT qid, unit_id FROM bm WHERE rank <= 10 UNION SELECT qid, unit_id FROM e WHERE r <= 10 UNION SELECT qid, unit_id FROM x""")
def graph_seeds(spark, d):
    """Ten lexical and ten entity units, and the first unit with the query's rarest term."""
    u, q = _units(spark, d), _queries(spark, d)
    mention = F.explode(F.regexp_extract_all("query", F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0)))
    ents = q.select("qid", mention.alias("s")).select("qid", F.lower("s").alias("canon")).distinct().join(_mentions(spark, d), "canon").groupBy("qid", "unit_id").agg(F.count(F.lit(1)).alias("hits"))
    ents = ents.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("hits"), "unit_id"))).where("r <= 10")
    p = R.postings(u)
    df = p.groupBy("term").agg(F.countDistinct("unit_id").alias("df"))
    terms = q.select("qid", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term"))
    rare = terms.join(df, "term").groupBy("qid").agg(F.min(F.struct("df", "term"))["term"].alias("term"))
    first = rare.join(p.where("field = 'text'").groupBy("term").agg(F.min("unit_id").alias("unit_id")), "term")
    return _ranked(spark, d, 10).select("qid", "unit_id").union(ents.select("qid", "unit_id")).union(first.select("qid", "unit_id")).distinct()


@query("source_currency", """WITH r AS (SELECT o_custkey AS source, o_orderkey AS revision, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS current FROM orders)
SELECT intent, source, revision, CASE WHEN current THEN 'current' ELSE 'superseded' END AS label FROM r, (VALUES ('current_value'), ('history_of')) AS i(intent) WHERE current OR intent = 'history_of'""")
def source_currency(spark, d):
    """A question for the current value drops superseded revisions; one for the history labels them."""
    r = load(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("revision"), "o_orderdate")
    last = r.groupBy("source").agg(F.max(F.struct("o_orderdate", "revision")).alias("m")).select("source", F.col("m.revision").alias("newest"))
    now = F.col("revision") == F.col("newest")
    each = F.when(now, F.array(F.lit("current_value"), F.lit("history_of"))).otherwise(F.array(F.lit("history_of")))
    return r.join(last, "source").select(F.explode(each).alias("intent"), "source", "revision", F.when(now, "current").otherwise("superseded").alias("label"))


@query("missing_facets", f"""WITH {BM}, h AS (SELECT DISTINCT qid, unnest({tok('u.text')}) AS term FROM bm JOIN u USING (unit_id) WHERE rank <= 3)
SELECT qid, term FROM qt WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = qt.qid AND h.term = qt.term)""")
def missing_facets(spark, d):
    """Query terms that none of the first three results holds."""
    hits = _ranked(spark, d, 3).join(_units(spark, d).select("unit_id", "text"), "unit_id").select("qid", F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return R.query_terms(_queries(spark, d)).select("qid", "term").distinct().join(hits, ["qid", "term"], "left_anti")


FLOORS = "(0, 0.2), (1, 0.3), (2, 0.25), (3, 0.9)"


@query("similarity_floor", f"""WITH f AS (SELECT * FROM (VALUES {FLOORS}) AS v(label, least)), q AS (SELECT vec_id AS qid, label, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, q.label, vec_id, round(list_cosine_similarity(a, embedding::DOUBLE[]), 6) AS cos FROM q, embeddings WHERE vec_id <> qid) SELECT qid, count(*) AS passed, max(cos) AS best FROM s JOIN f USING (label) WHERE cos >= least GROUP BY 1""")
def similarity_floor(spark, d):
    """Candidates that reach the floor of the query's class; classes without a floor have none."""
    from loomwork.functions import scoring

    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("a"))
    q = q.join(F.broadcast(rows(spark, FLOORS, "label INT, least DOUBLE")), "label")  # a table of classes
    s = e.select("vec_id", "embedding").crossJoin(q).where("vec_id <> qid").select("qid", "least", scoring.cosine(F.col("a"), F.col("embedding")).alias("c"))
    return s.select("qid", "least", F.round("c", 6).alias("cos")).where("cos >= least").groupBy("qid").agg(F.count(F.lit(1)).alias("passed"), F.max("cos").alias("best"))


@query("computed_answers", """WITH r AS (SELECT user_id, event_type AS ref, min(ts) AS lo, max(ts) AS hi, arg_max(value, (ts, value)) AS v FROM events GROUP BY 1, 2)
SELECT user_id, CASE WHEN count(*) >= 2 THEN count(*) END AS n, CASE WHEN count(*) >= 2 THEN string_agg(ref, '>' ORDER BY lo, ref) END AS "order",
floor((epoch_us(max(hi)) - epoch_us(min(lo))) / 86400000000)::BIGINT AS days, arg_max(v, (hi, ref)) AS current, count(*) AS versions FROM r GROUP BY 1""")
def computed_answers(spark, d):
    """Order, count, duration and current value over each user's dated evidence."""
    e = load(spark, d, "events").select("user_id", F.col("event_type").alias("ref"), F.col("ts").cast("timestamp").alias("at"), "value")
    return A.computed(e, "user_id").withColumn("versions", F.col("versions"))


@query("reader_view", f"""WITH {BM} SELECT qid, string_agg('[' || rank || '] ' || speaker || ': ' || replace(text, chr(10), ' '), chr(10) ORDER BY rank) AS view FROM bm JOIN u USING (unit_id) WHERE rank <= 3 GROUP BY 1""")
def reader_view(spark, d):
    """A deterministic rendering of the first three results."""
    t = _ranked(spark, d, 3).join(_units(spark, d).select("unit_id", "speaker", "text"), "unit_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("speaker"), F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" ")))
    return t.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l")).select("qid", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("view"))


# one case for each branch, with the label the rule states
GROUPS = """(1, 2, 2, 0.0, 0.0, false, false, true, false, 'supported'), (2, 2, 1, 0.0, 0.0, false, false, true, false, 'partial'), (3, 1, 0, 0.5, 0.0, false, false, true, false, 'partial'),
(4, 1, 0, 0.1, 1.0, false, false, true, false, 'partial'), (5, 1, 0, 0.1, 0.0, false, false, false, false, 'partial'), (6, 1, 0, 0.49, 0.9, true, true, true, true, 'weak'),
(7, 0, 0, 0.6, 0.0, false, false, true, false, 'supported'), (8, 0, 0, 0.4, 0.0, false, true, true, false, 'supported'), (9, 0, 0, 0.5, 0.0, true, false, true, false, 'supported'),
(10, 0, 0, 0.25, 1.0, false, false, true, false, 'supported'), (11, 0, 0, 0.0, 1.0, false, true, true, true, 'supported'), (12, 0, 0, 0.59, 0.0, false, false, true, false, 'partial'),
(13, 0, 0, 0.2, 0.5, false, false, true, false, 'partial'), (14, 0, 0, 0.2, 0.1, true, false, true, false, 'partial'), (15, 0, 0, 0.2, 0.1, false, true, true, false, 'partial'), (16, 0, 0, 0.24, 0.49, false, false, true, false, 'weak')"""
GROUP_COLUMNS = "id INT, asked INT, matched INT, cov DOUBLE, ent DOUBLE, window BOOLEAN, real BOOLEAN, measured BOOLEAN, only BOOLEAN, label STRING"


@query("group_support", f"SELECT id, label FROM (VALUES {GROUPS}) AS v(id, asked, matched, cov, ent, w, r, m, o, label)")
def group_support(spark, d):
    """The label of evidence groups, one for each branch of the rule; the SQL states the expected labels."""
    g = rows(spark, GROUPS, GROUP_COLUMNS)
    return g.select("id", A.support({c.split()[0]: F.col(c.split()[0]) for c in GROUP_COLUMNS.split(", ")}).alias("label"))


STATUS = "(1, 0, true, true, true, true, 'no_evidence'), (2, 3, true, true, false, true, 'contradicted_premise'), (3, 3, false, true, true, true, 'supported'), (4, 3, false, false, true, true, 'unverified_premise'), (5, 2, false, false, false, true, 'partial'), (6, 1, false, false, false, false, 'weak_only')"


@query("answerability", f"SELECT id, status FROM (VALUES {STATUS}) AS v(id, n, c, s, p, q, status)")
def answerability(spark, d):
    g = rows(spark, STATUS, "id INT, n INT, c BOOLEAN, s BOOLEAN, p BOOLEAN, q BOOLEAN, status STRING")
    return g.select("id", A.answerability(*[F.col(c) for c in "ncspq"]).alias("status"))


# prior, new, values of the prior, negations, event times, whether an entity is shared, and the expected relation
PAIRS = """(1, 'rent is 900', 'rent is 950', '900', false, false, 1, 2, false, 'newer_value'), (2, 'the shop is open', 'the shop is open', '', false, true, 1, 2, false, 'negates'),
(3, 'the shop is open', 'the shop is open', '', true, false, 1, 2, false, 'contradicts'), (4, 'anna likes green tea', 'anna likes black coffee', '', false, false, 1, 1, false, 'contradicts'),
(5, 'anna likes tea', 'anna likes tea with milk', '', false, false, 1, 1, false, 'refines'), (6, 'anna likes tea', 'anna likes tea', '', false, false, 1, 9, false, 'newer_value'),
(7, 'anna likes tea', 'anna likes tea', '', false, false, 1, 1, false, NULL), (8, 'anna left', 'anna arrived', '', false, false, 1, 1, false, NULL), (9, 'anna left', 'anna arrived', '', false, false, 1, 1, true, 'contradicts'),
(10, 'anna likes tea with milk', 'anna likes tea', '', false, false, 1, 1, false, NULL)"""


@query("update_rules", f"SELECT id, relation FROM (VALUES {PAIRS}) AS v(id, a, b, x, na, nb, ta, tb, e, relation)")
def update_rules(spark, d):
    """Update relations of stated pairs, one for each branch; the SQL states the expected ones."""
    p = rows(spark, PAIRS, "id INT, a STRING, b STRING, x STRING, na BOOLEAN, nb BOOLEAN, ta INT, tb INT, e BOOLEAN, relation STRING")
    words = lambda c: F.array_distinct(text.tokens(F.col(c)))
    prior = {"words": words("a"), "values": words("x"), "negated": F.col("na"), "at": F.col("ta")}
    new = {"words": words("b"), "values": words("x"), "negated": F.col("nb"), "at": F.col("tb")}
    return p.select("id", A.relation(prior, new, F.col("e")).alias("relation"))


@query("truncate_at_sentence", r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, s, len(list_filter(range(1, least(len(s), 200) + 1), lambda i: ceil(strlen(array_to_string(s[1:i], '')) / 4.0) <= 64)) AS k FROM s)
SELECT doc_id, CASE WHEN k = 0 AND len(s) > 0 THEN s[1] ELSE array_to_string(s[1:k], '') END AS cut FROM c""")
def truncate_at_sentence(spark, d):
    """Whole sentences from the start within 64 tokens; the first alone if it is longer.

    (The SQL looks at 200 sentences: 64 tokens of four bytes hold no more.)
    """
    return load(spark, d, "documents").where("text is not null").select("doc_id", A.close_sentences(F.col("text"), 64).alias("cut"))


def _plain_letters() -> tuple[str, str]:
    """Lower-case Latin letters whose canonical decomposition starts with an ASCII letter, and that letter."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if chr(c).islower() and unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED_LETTERS, BARE_LETTERS = _plain_letters()


@query("entity_fold", r"""WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS word FROM conversations) SELECT strip_accents(word) AS folded, count(*) AS spellings FROM u GROUP BY 1""")
def entity_fold(spark, d):
    """Words without their marks, and how many spellings each has."""
    u = load(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    return u.groupBy(F.translate("word", MARKED_LETTERS, BARE_LETTERS).alias("folded")).agg(F.count(F.lit(1)).alias("spellings"))


SPANS = "(0, 10), (0, 4), (4, 10), (2, 6), (0, 6), (6, 10), (10, 14), (12, 14), (4, 6)"
NAMES = {"before": "a.e < b.s", "after": "a.s > b.e", "meets": "a.e = b.s", "met_by": "a.s = b.e", "equals": "a.s = b.s AND a.e = b.e", "starts": "a.s = b.s AND a.e < b.e", "started_by": "a.s = b.s AND a.e > b.e",
         "finishes": "a.e = b.e AND a.s > b.s", "finished_by": "a.e = b.e AND a.s < b.s", "during": "a.s > b.s AND a.e < b.e", "contains": "a.s < b.s AND a.e > b.e",
         "overlaps": "a.s < b.s AND a.e > b.s AND a.e < b.e", "overlapped_by": "a.s > b.s AND a.s < b.e AND a.e > b.e"}


@query("allen_thirteen", f"WITH x AS (SELECT * FROM (VALUES {SPANS}) AS v(s, e)) " + " UNION ALL ".join(f"SELECT a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, '{n}' AS relation FROM x a, x b WHERE {c}" for n, c in NAMES.items()))
def allen_thirteen(spark, d):
    """All pairs of nine stated intervals: every one of the thirteen relations occurs."""
    x = rows(spark, SPANS, "s BIGINT, e BIGINT")
    p = x.toDF("s1", "e1").crossJoin(x.toDF("s2", "e2"))  # 81 rows
    return p.select(*[F.col(c).cast("int").alias(c) for c in ("s1", "e1", "s2", "e2")], intervals.allen(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")).alias("relation"))
