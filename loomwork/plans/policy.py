"""Registered queries on lifecycles, gates, cursors and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text
from loomwork.operators import consolidate, policy
from loomwork.plans.answers import rows
from loomwork.plans.registry import load, query


@query("json_array_unnest", """WITH o AS (SELECT l_orderkey, to_json(list(l_partkey ORDER BY l_linenumber)) AS refs FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, unnest(from_json(refs, '["BIGINT"]')) AS p FROM o)
SELECT DISTINCT l_orderkey FROM x WHERE p IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size < 5)""")
def json_array_unnest(spark, d):
    """Rows whose JSON array of references names a flagged object."""
    o = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_partkey")).alias("refs"))
    x = o.select("l_orderkey", F.explode(F.from_json("refs", "array<bigint>")).alias("p"))
    flagged = load(spark, d, "part").where("p_type = 'PROMO' and p_size < 5").select(F.col("p_partkey").alias("p"))
    return x.join(flagged, "p", "left_semi").select("l_orderkey").distinct()


@query("namespaced_scope", """SELECT o_orderkey FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS ns FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON l_orderkey = o_orderkey
JOIN customer ON c_custkey = o_custkey WHERE coalesce(ns, c_nationkey) IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def namespaced_scope(spark, d):
    """A source counts in the namespace its state names, or else in its own scope."""
    state = load(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("ns"))
    o = load(spark, d, "orders").join(state, "o_orderkey", "left").join(load(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    allowed = load(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("scope"))
    return o.withColumn("scope", F.coalesce("ns", F.col("c_nationkey").cast("long"))).join(allowed, "scope", "left_semi").select("o_orderkey")


@query("residual_claims", """SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' AND l_linestatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01'
AND l_shipdate <= TIMESTAMP '1995-06-01' AND l_shipdate + INTERVAL 30 DAY > TIMESTAMP '1995-01-15'""")
def residual_claims(spark, d):
    """State, modality, recorded-time and validity predicates on claims; all but one reach the scan."""
    c = load(spark, d, "lineitem").where("l_returnflag <> 'R' and l_linestatus = 'F' and l_shipdate <= timestamp_ntz'1995-06-01' and l_shipdate > timestamp_ntz'1994-12-16'")
    o = load(spark, d, "orders").where("o_orderdate < timestamp_ntz'1995-01-01'")
    return c.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber")


@query("batched_admission", """WITH k AS (SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'ghost', n_nationkey FROM nation)
SELECT kind, id, CASE kind WHEN 'order' THEN id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') WHEN 'part' THEN id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) ELSE false END AS admitted FROM k""")
def batched_admission(spark, d):
    """One verdict for each (kind, id); an unknown kind admits nothing."""
    key = lambda t, kind, c: load(spark, d, t).select(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("id"))
    keys = key("orders", "order", "o_orderkey").union(key("part", "part", "p_partkey")).union(key("nation", "ghost", "n_nationkey"))
    return policy.admit(keys, {
        "order": load(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id")),
        "part": load(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("id")),
    })


MOVES = "(NULL, 'signup'), ('signup', 'view'), ('signup', 'click'), ('view', 'click'), ('click', 'view'), ('click', 'purchase'), ('view', 'error'), ('error', 'view'), ('purchase', 'view')"


@query("claim_lifecycle", f"""WITH m AS (SELECT * FROM (VALUES {MOVES}) AS v(src, dst)), t AS (SELECT event_id, user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, before, CASE WHEN before = state THEN 'same' WHEN EXISTS (SELECT 1 FROM m WHERE src IS NOT DISTINCT FROM before AND dst = state) THEN 'accepted' ELSE 'refused' END AS verdict FROM t""")
def claim_lifecycle(spark, d):
    """Each command against the table of allowed moves."""
    log = load(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("state"))
    return policy.replay(log, rows(spark, MOVES, "src STRING, dst STRING"), "user_id", ["ts", "event_id"]).select("event_id", "before", "verdict")


NEEDS = "('purchase', 'click'), ('click', 'view'), ('view', 'signup'), ('error', 'signup')"


@query("readiness_barrier", f"""WITH RECURSIVE n AS (SELECT * FROM (VALUES {NEEDS}) AS v(capability, needs)), c AS (SELECT capability, needs FROM n UNION SELECT c.capability, n.needs FROM c JOIN n ON n.capability = c.needs),
s AS (SELECT user_id AS item, event_type AS capability, max(value) > 40 AS done FROM events GROUP BY 1, 2)
SELECT s.item, s.capability, s.done AND NOT EXISTS (SELECT 1 FROM c JOIN s b ON b.capability = c.needs WHERE c.capability = s.capability AND b.item = s.item AND NOT b.done) AS ready FROM s""")
def readiness_barrier(spark, d):
    """A capability is ready when it and all that it depends on are done for the item."""
    s = load(spark, d, "events").groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("capability")).agg((F.max("value") > 40).alias("done"))
    return policy.readiness(s, rows(spark, NEEDS, "capability STRING, needs STRING"))


FACTS = "f AS (SELECT user_id AS slot, event_type AS value, event_id AS t FROM events)"
BELIEF = "SELECT slot, value, count(*) AS proof, min(t) AS first, max(t) AS last, count(*) OVER (PARTITION BY slot) - 1 AS rivals FROM {} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY slot ORDER BY count(*) DESC, max(t) DESC) = 1"


@query("windowed_consolidation", f"WITH {FACTS} {BELIEF.format('f')}")
def windowed_consolidation(spark, d):
    """Beliefs stored at nine tenths of the events, then brought up to date for the touched slots: equal to working all out anew."""
    f = load(spark, d, "events").select(F.col("user_id").alias("slot"), F.col("event_type").alias("value"), F.col("event_id").alias("at"))
    cut = f.agg(F.expr("max(at) * 9 div 10").alias("cut"))  # one row
    marked = f.join(F.broadcast(cut))
    stored = consolidate.beliefs(marked.where("at < cut"))
    return consolidate.windowed(stored, marked, F.col("cut")).select("slot", "value", "proof", "first", "last", "rivals")


@query("quality_report", f"""WITH {FACTS}, g AS (SELECT slot, count(DISTINCT value) AS vals, max(t) AS newest, count(*) AS n FROM f GROUP BY 1)
SELECT count(*) AS slots, count(*) FILTER (vals = 1) AS settled, count(*) FILTER (vals > 1) AS conflicted, count(*) FILTER (newest < (SELECT max(t) * 9 // 10 FROM f)) AS stale FROM g""")
def quality_report(spark, d):
    """How many slots are settled, conflicted or stale."""
    f = load(spark, d, "events")
    newest = f.agg(F.expr("max(event_id) * 9 div 10").alias("cut"))  # one row
    g = f.groupBy("user_id").agg(F.countDistinct("event_type").alias("vals"), F.max("event_id").alias("newest")).join(F.broadcast(newest))
    return g.agg(F.count(F.lit(1)).alias("slots"), F.count_if(F.expr("vals = 1")).alias("settled"), F.count_if(F.expr("vals > 1")).alias("conflicted"), F.count_if(F.expr("newest < cut")).alias("stale"))


@query("auto_update_gate", """WITH t AS (SELECT event_id, user_id, event_type, value, lag(event_id) OVER w AS prior, lag(value) OVER w AS old, count(*) OVER (PARTITION BY user_id, event_type, ts::DATE) AS twins FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, prior, CASE WHEN prior IS NULL THEN 'new' WHEN twins > 1 THEN 'held_twins' WHEN abs(value - old) <= old * 0.5 THEN 'replaced' ELSE 'proposed' END AS verdict FROM t""")
def auto_update_gate(spark, d):
    """A newer value replaces the older by itself only if it is close to it and has no twin of the same day."""
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = load(spark, d, "events").withColumn("day", F.to_date("ts"))
    t = e.select("event_id", "value", F.lag("event_id").over(w).alias("prior"), F.lag("value").over(w).alias("old"), F.count(F.lit(1)).over(W.partitionBy("user_id", "event_type", "day")).alias("twins"))
    verdict = F.when(F.col("prior").isNull(), "new").when(F.col("twins") > 1, "held_twins").when(F.abs(F.col("value") - F.col("old")) <= F.col("old") * 0.5, "replaced").otherwise("proposed")
    return t.select("event_id", "prior", verdict.alias("verdict"))


@query("purge_phases", """WITH p AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey % 40 = 0), x AS (SELECT l_orderkey, l_linenumber FROM lineitem JOIN p ON l_orderkey = id)
SELECT 'preview' AS phase, (SELECT count(*) FROM p) AS sources, (SELECT count(*) FROM x) AS derived, (SELECT count(*) FROM lineitem) AS visible
UNION ALL SELECT 'suppress', (SELECT count(*) FROM p), (SELECT count(*) FROM x), (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM x)
UNION ALL SELECT 'execute', 0, 0, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM x)""")
def purge_phases(spark, d):
    """What each phase of an erasure shows: the preview changes nothing, suppression hides, execution leaves no trace."""
    p = load(spark, d, "orders").where("o_custkey % 40 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    l = load(spark, d, "lineitem").join(p.withColumn("hit", F.lit(True)), "l_orderkey", "left")
    n = l.agg(F.count_if("hit").alias("derived"), F.count(F.lit(1)).alias("all")).join(p.agg(F.count(F.lit(1)).alias("sources")))  # one row each
    left = F.col("all") - F.col("derived")
    phase = lambda name, s, x, v: F.struct(F.lit(name).alias("phase"), s.alias("sources"), x.alias("derived"), v.alias("visible"))
    none = F.lit(0).cast("long")
    each = F.array(phase("preview", F.col("sources"), F.col("derived"), F.col("all")), phase("suppress", F.col("sources"), F.col("derived"), left), phase("execute", none, none, left))
    return n.select(F.explode(each).alias("x")).select("x.*")


@query("consent_gate", """WITH s AS (SELECT event_id, user_id, event_type, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events)
SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'no_consent' WHEN event_type = 'error' THEN 'wrong_purpose' WHEN spent > 1000 THEN 'over_budget' ELSE 'allowed' END AS verdict FROM s LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0""")
def consent_gate(spark, d):
    """Consent, purpose, then the running budget."""
    spent = F.sum("value").over(W.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")))
    s = load(spark, d, "events").withColumn("spent", spent)
    c = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("given"))
    verdict = F.when(F.col("given").isNull(), "no_consent").when(F.col("event_type") == "error", "wrong_purpose").when(F.col("spent") > 1000, "over_budget").otherwise("allowed")
    return s.join(c, "user_id", "left").select("event_id", verdict.alias("verdict"))


@query("consolidation_cursor", "SELECT user_id % 16 AS shard, max(event_id) AS mark, count(*) FILTER (event_id > 300) AS fresh FROM events GROUP BY 1")
def consolidation_cursor(spark, d):
    """A cursor by shard: the second pass sees only what lies beyond the mark."""
    e = load(spark, d, "events").select((F.col("user_id") % 16).alias("shard"), F.col("event_id").alias("seq"))
    start = rows(spark, ", ".join(f"({k}, 300)" for k in range(16)), "shard BIGINT, mark BIGINT")
    fresh, after = consolidate.past_cursor(e, start)
    return after.join(fresh.groupBy("shard").agg(F.count(F.lit(1)).alias("fresh")), "shard").select("shard", "mark", "fresh")


@query("block_compaction", "WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings) SELECT vec_id, label, i // 16 AS block, i % 16 AS place FROM r")
def block_compaction(spark, d):
    """Vectors of each space repacked in full blocks."""
    return consolidate.blocks(load(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 16).select("vec_id", "label", "block", "place")


@query("synthesis_sections", """SELECT user_id, string_agg(event_type || ' x' || n, '; ' ORDER BY n DESC, event_type) AS activity, max(first) FILTER (event_type = 'signup') AS joined, sum(n)::BIGINT AS evidence
FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1""")
def synthesis_sections(spark, d):
    """A subject's page: declared sections over counted evidence."""
    g = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    line = F.struct((-F.col("n")).alias("o"), "event_type", F.concat("event_type", F.lit(" x"), F.col("n").cast("string")).alias("line"))
    s = g.groupBy("user_id").agg(F.array_sort(F.collect_list(line)).alias("l"), F.max(F.when(F.col("event_type") == "signup", F.col("first"))).alias("joined"), F.sum("n").alias("evidence"))
    return s.select("user_id", F.array_join(F.transform("l", lambda x: x["line"]), "; ").alias("activity"), "joined", "evidence")


@query("inspect_object", """SELECT l_orderkey, l_linenumber, o_custkey AS source, p_name AS cites, s_name AS producer, o_orderdate AS recorded FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = 7""")
def inspect_object(spark, d):
    """Provenance and evidence of one object; the key reaches both scans."""
    l = load(spark, d, "lineitem").where("l_orderkey = 7").join(load(spark, d, "orders").where("o_orderkey = 7"), F.col("o_orderkey") == F.col("l_orderkey"))
    l = l.join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"), "left").join(load(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return l.select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("source"), F.col("p_name").alias("cites"), F.col("s_name").alias("producer"), F.col("o_orderdate").alias("recorded"))


@query("interval_shift", """SELECT o_orderkey, o_orderdate + INTERVAL (o_orderkey % 5 - 2) MONTH AS months, o_orderdate + INTERVAL (o_orderkey % 7 - 3) DAY AS days, o_orderdate - INTERVAL (o_orderkey % 3) YEAR AS years FROM orders""")
def interval_shift(spark, d):
    """Bounds moved by months (the day clamped), days and years."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    months = at + F.make_interval(months=(k % 5 - 2).cast("int"))
    return load(spark, d, "orders").select("o_orderkey", months.alias("months"), (at + F.make_interval(days=(k % 7 - 3).cast("int"))).alias("days"), (at - F.make_interval(years=(k % 3).cast("int"))).alias("years"))


GRADES = "('instant', 0), ('day', 1), ('week', 2), ('month', 3), ('year', 4), ('unknown', 5)"


@query("precision_floor", f"WITH g AS (SELECT * FROM (VALUES {GRADES}) AS v(name, r)) SELECT a.name AS a, b.name AS b, CASE WHEN a.r >= b.r THEN a.name ELSE b.name END AS floor FROM g a, g b")
def precision_floor(spark, d):
    """The coarser of two precisions."""
    g = rows(spark, GRADES, "name STRING, r INT")
    p = g.toDF("a", "ra").crossJoin(g.toDF("b", "rb"))  # 36 rows
    return p.select("a", "b", F.greatest(F.struct("ra", F.col("a").alias("n")), F.struct(F.col("rb").alias("ra"), F.col("b").alias("n")))["n"].alias("floor"))


SAID = "(1, 10, 20), (1, 15, 40), (2, NULL, 5), (2, 3, 9), (3, 7, NULL), (4, NULL, NULL), (4, 1, 2), (5, NULL, NULL)"


@query("query_window", f"""SELECT qid, CASE WHEN count(*) FILTER (s IS NULL AND e IS NOT NULL) > 0 THEN NULL ELSE min(s) END AS lo, CASE WHEN count(*) FILTER (e IS NULL AND s IS NOT NULL) > 0 THEN NULL ELSE max(e) END AS hi
FROM (VALUES {SAID}) AS v(qid, s, e) WHERE s IS NOT NULL OR e IS NOT NULL GROUP BY 1""")
def query_window(spark, d):
    """One window that covers all of a query's expressions; an open bound stays open, unresolved ones don't count."""
    v = rows(spark, SAID, "qid INT, s INT, e INT").where("s is not null or e is not null")
    lo = F.when(F.count_if(F.col("s").isNull()) == 0, F.min("s"))
    hi = F.when(F.count_if(F.col("e").isNull()) == 0, F.max("e"))
    return v.groupBy("qid").agg(lo.alias("lo"), hi.alias("hi"))


@query("signed_duration", """WITH t AS (SELECT user_id, event_type, min(ts) AS s, max(ts) AS e FROM events GROUP BY 1, 2), p AS (SELECT a.user_id, a.event_type AS a, b.event_type AS b, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_type < b.event_type)
SELECT user_id, a, b, epoch_us(s2) - epoch_us(s1) AS duration, CASE WHEN e1 < s2 THEN epoch_us(s2) - epoch_us(e1) WHEN e2 < s1 THEN epoch_us(e2) - epoch_us(s1) ELSE 0 END AS gap, epoch_us(greatest(e1, e2)) - epoch_us(least(s1, s2)) AS span FROM p""")
def signed_duration(spark, d):
    """Between two intervals: start to start, the gap (negative if the second comes first), and the span of both."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    t = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(us("ts")).alias("s"), F.max(us("ts")).alias("e"))
    p = t.toDF("user_id", "a", "s1", "e1").join(t.toDF("user_id", "b", "s2", "e2"), "user_id").where("a < b")
    gap = F.when(F.col("e1") < F.col("s2"), F.col("s2") - F.col("e1")).when(F.col("e2") < F.col("s1"), F.col("e2") - F.col("s1")).otherwise(0)
    return p.select("user_id", "a", "b", (F.col("s2") - F.col("s1")).alias("duration"), gap.alias("gap"), (F.greatest("e1", "e2") - F.least("s1", "s2")).alias("span"))


CLAIMS = "(1, 'anna works at the mill in york'), (2, 'anna works at the bank in york'), (3, 'anna works at the bank'), (4, 'ben swims'), (5, 'ben swims in the lake'), (6, 'a mill burned in york')"


@query("relation_discovery", f"""WITH c AS (SELECT * FROM (VALUES {CLAIMS}) AS v(id, text)), w AS (SELECT id, unnest(list_distinct(string_split(text, ' '))) AS w FROM c), n AS (SELECT id, count(*) AS n FROM w GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, min(x.n) AS na, min(y.n) AS nb FROM w a JOIN w b ON a.w = b.w AND a.id <> b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY 1, 2),
r AS (SELECT *, shared / sqrt(na * nb) AS sim FROM p) SELECT a, b, round(sim, 6)::DOUBLE AS sim, CASE WHEN shared = na THEN 'refined_by' WHEN shared = nb THEN 'refines' WHEN sim >= 0.7 THEN 'rival' ELSE 'related' END AS relation FROM r
QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 2""")
def relation_discovery(spark, d):
    """Each claim against its most similar ones, found by shared words."""
    w = rows(spark, CLAIMS, "id INT, text STRING").select("id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    n = w.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    p = w.toDF("a", "w").join(w.toDF("b", "w"), "w").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    p = p.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").withColumn("sim", F.col("shared") / F.sqrt(F.col("na") * F.col("nb")))
    kind = F.when(F.col("shared") == F.col("na"), "refined_by").when(F.col("shared") == F.col("nb"), "refines").when(F.col("sim") >= 0.7, "rival").otherwise("related")
    r = F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return p.withColumn("r", r).where("r <= 2").select("a", "b", F.round("sim", 6).alias("sim"), kind.alias("relation"))


ASKED = "(1, 'who bought the red car and where is the key'), (2, 'where is anna?'), (3, 'list the birds and the trees and the lakes and the hills'), (4, NULL)"
PARTS = "(1, 0, 'who bought the red car'), (1, 1, 'where is the key'), (2, 0, 'where is anna'), (3, 0, 'list the birds'), (3, 1, 'the trees'), (3, 2, 'the lakes')"


@query("facet_decomposition", f"SELECT qid, facet::BIGINT AS facet, part FROM (VALUES {PARTS}) AS v(qid, facet, part)")
def facet_decomposition(spark, d):
    """Up to three sub-queries by conjunction; the SQL states the expected ones."""
    q = rows(spark, ASKED, "qid INT, text STRING")
    parts = F.split(F.regexp_replace("text", r"[?!.]+\s*$", ""), r"(?i)\s+and\s+", -1)
    return q.select("qid", F.posexplode(parts).alias("facet", "part")).where("facet < 3 and part <> ''").select("qid", F.col("facet").cast("long").alias("facet"), "part")


@query("lane_registry", """SELECT lane, count(*) AS rows FROM (SELECT 'recent' AS lane, event_id FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id) <= 50
UNION ALL SELECT 'large', event_id FROM events WHERE value > 100 UNION ALL SELECT 'typed', event_id FROM events WHERE event_type = 'error') GROUP BY 1""")
def lane_registry(spark, d):
    """Lanes that callers register by name, run together under one schema."""
    from loomwork.operators import lanes

    reg = lanes.Registry()
    reg.register("recent", lambda e: e.orderBy(F.desc("ts"), "event_id").limit(50).select(F.col("event_id").alias("unit_id"), F.lit(1.0).alias("score")))
    reg.register("large", lambda e: e.where("value > 100").select(F.col("event_id").alias("unit_id"), F.col("value").alias("score")))
    reg.register("typed", lambda e: e.where("event_type = 'error'").select(F.col("event_id").alias("unit_id"), F.lit(0.5).alias("score")))
    return reg.run(load(spark, d, "events"), ["recent", "large", "typed"]).groupBy("lane").agg(F.count(F.lit(1)).alias("rows"))


@query("resumed_backfill", """SELECT pass, event_type, count(*) AS n FROM (SELECT event_type, unnest(CASE WHEN event_id % 4 < 2 THEN [1, 2] ELSE [2] END) AS pass FROM events) GROUP BY 1, 2""")
def resumed_backfill(spark, d):
    """Two passes with one checkpoint: half of the files, then the rest; the second reads only what is new."""
    from loomwork.scratch import Scratch
    from loomwork.streaming.incremental import backfill

    e, s = load(spark, d, "events").select("event_id", "event_type"), Scratch(spark, "backfill")
    src, out, mark = s.path("in"), s.path("out"), s.path("checkpoint")
    passes = None
    for k, part in ((1, "event_id % 4 < 2"), (2, "event_id % 4 >= 2")):
        e.where(part).repartition(2).write.mode("append").parquet(src)
        backfill(spark, src, e.schema, out, mark)
        now = s.save(spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), f"pass{k}").select(F.lit(k).alias("pass"), "event_type", "n")
        passes = now if passes is None else passes.unionByName(now)
    return passes


# text, anchor, and the expected mentions, read off by hand
MENTIONED = "(1, 'met on 2024-02-03 and again the other day', '2024-05-15 12:00:00'), (2, 'since 2020', '2024-05-15 00:00:00'), (3, 'nothing dated', '2024-05-15 00:00:00'), (4, 'late March 2023 or someday', '2024-05-15 00:00:00')"
EXPECTED = """(1, '2024-02-03', TIMESTAMP '2024-02-03 00:00:00', TIMESTAMP '2024-02-04 00:00:00', 'day'), (1, 'the other day', TIMESTAMP '2024-05-08 00:00:00', TIMESTAMP '2024-05-15 00:00:00', 'week'),
(2, '2020', TIMESTAMP '2020-01-01 00:00:00', TIMESTAMP '2024-05-15 00:00:00', 'year'), (4, 'late march 2023', TIMESTAMP '2023-03-21 00:00:00', TIMESTAMP '2023-04-01 00:00:00', 'day'), (4, 'someday', NULL, NULL, 'unknown')"""


@query("relative_mentions", f"SELECT unit_id, phrase, epoch_us(s) AS start_us, epoch_us(e) AS end_us, grade AS precision FROM (VALUES {EXPECTED}) AS v(unit_id, phrase, s, e, grade)")
def relative_mentions(spark, d):
    """The dated mentions that a unit gets when it is written."""
    from loomwork.functions.timephrases import time_phrases

    t = rows(spark, MENTIONED, "unit_id INT, text STRING, at STRING").withColumn("anchor", F.unix_micros(F.to_timestamp("at")))
    return t.select("unit_id", F.explode(time_phrases("text", "anchor")).alias("m")).select("unit_id", "m.*")


CLASS_FLOORS = "('lookup', 0.5, 0.2), ('temporal', 0.4, 0.1), ('count', 0.8, 0.5)"


@query("class_verdicts", f"""WITH f AS (SELECT * FROM (VALUES {CLASS_FLOORS}) AS v(class, hi, lo)), e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'lookup' WHEN 'click' THEN 'temporal' WHEN 'purchase' THEN 'count' ELSE 'other' END AS class, value / 100 AS support FROM events)
SELECT event_id, CASE WHEN hi IS NULL THEN 'unrated' WHEN support >= hi THEN 'answer' WHEN support >= lo THEN 'hedge' ELSE 'abstain' END AS verdict FROM e LEFT JOIN f USING (class)""")
def class_verdicts(spark, d):
    """Per-class thresholds on support."""
    kind = F.when(F.col("event_type") == "view", "lookup").when(F.col("event_type") == "click", "temporal").when(F.col("event_type") == "purchase", "count").otherwise("other")
    e = load(spark, d, "events").select("event_id", kind.alias("class"), (F.col("value") / 100).alias("support"))
    f = F.broadcast(rows(spark, CLASS_FLOORS, "class STRING, hi DOUBLE, lo DOUBLE"))  # a table of rules
    verdict = F.when(F.col("hi").isNull(), "unrated").when(F.col("support") >= F.col("hi"), "answer").when(F.col("support") >= F.col("lo"), "hedge").otherwise("abstain")
    return e.join(f, "class", "left").select("event_id", verdict.alias("verdict"))


@query("hard_identifier_abstention", """WITH a AS (SELECT o_orderkey AS qid, unnest([o_custkey, o_custkey + 100000 * (o_orderkey % 3)]) AS id FROM orders WHERE o_orderkey % 20 = 0), h AS (SELECT qid, id, id IN (SELECT c_custkey FROM customer) AS found FROM (SELECT DISTINCT qid, id FROM a))
SELECT qid, CASE WHEN count(*) FILTER (found) = 0 THEN 'abstain' WHEN count(*) FILTER (NOT found) > 0 THEN 'partial' ELSE 'answer' END AS verdict FROM h GROUP BY 1""")
def hard_identifier_abstention(spark, d):
    """A question whose identifiers match nothing is not answered; one with some of them only in part."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = load(spark, d, "orders").where("o_orderkey % 20 = 0").select(k.alias("qid"), F.explode(F.array(c, c + 100000 * (k % 3))).alias("id")).distinct()
    known = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(True).alias("found"))
    g = a.join(known, "id", "left").groupBy("qid").agg(F.count("found").alias("n"), F.count(F.lit(1)).alias("all"))
    return g.select("qid", F.when(F.col("n") == 0, "abstain").when(F.col("n") < F.col("all"), "partial").otherwise("answer").alias("verdict"))


@query("feature_functions", """SELECT event_id, round(0.7 * least(value / 100, 1) + 0.3 * CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END, 6)::DOUBLE AS score FROM events""")
def feature_functions(spark, d):
    """Features that callers inject as functions, weighted and summed."""
    from loomwork.operators import lanes

    reg = lanes.Features()
    reg.register("size", 0.7, lambda: F.least(F.col("value") / 100, F.lit(1.0)))
    reg.register("kind", 0.3, lambda: F.col("event_type").isin("purchase", "signup").cast("double"))
    return load(spark, d, "events").select("event_id", F.round(reg.score(), 6).alias("score"))
