"""Registered lifecycle, access and freshness queries.

The star schema stands in for the control tables: orders are sources with a
state, lineitem rows are derived objects, suppliers are recipients.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators import lineage, retrieval as R
from loomwork.plans.registry import load, query
from loomwork.plans.retrieval import UNITS, tok


@query("generation_fence", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events
WHERE event_id <= (SELECT max(event_id) * 7 // 10 FROM events)) WHERE r = 1""")
def generation_fence(spark, d):
    """All scopes, pinned at a generation (seven tenths of the newest): the newest version of each key up to it."""
    e = load(spark, d, "events")
    pin = e.agg(F.expr("max(event_id) * 7 div 10").alias("pin"))  # one row
    return e.join(F.broadcast(pin), F.col("event_id") <= F.col("pin")).groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))


@query("eligible_units", f"""WITH {UNITS} SELECT unit_id FROM u WHERE unit_id % 13 <> 0 AND session_id NOT IN (SELECT item_id FROM benchmark WHERE item_id % 3 = 0)""")
def eligible_units(spark, d):
    """Units minus quarantined ones and those of purged sessions."""
    purged = load(spark, d, "benchmark").where("item_id % 3 = 0").select(F.col("item_id").alias("session_id"))
    return R.units(load(spark, d, "conversations")).where("unit_id % 13 <> 0").join(purged, "session_id", "left_anti").select("unit_id")


@query("eligible_statistics", f"""WITH {UNITS} SELECT 'text' AS field, count(*) AS n_units, sum(len({tok('text')}))::BIGINT AS total_len FROM u WHERE unit_id % 13 <> 0
AND session_id NOT IN (SELECT item_id FROM benchmark WHERE item_id % 3 = 0)""")
def eligible_statistics(spark, d):
    """Corpus statistics over the eligible set only, never the whole set's."""
    u = R.units(load(spark, d, "conversations"))
    return R.statistics(u.join(eligible_units(spark, d), "unit_id", "left_semi"), ["text"])


@query("grant_authorization", """WITH RECURSIVE g AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END AS parent, s_suppkey % 7 <> 0 AS live FROM supplier),
ok AS (SELECT id FROM g WHERE parent IS NULL AND live UNION SELECT g.id FROM g JOIN ok ON g.parent = ok.id WHERE g.live) SELECT id FROM ok""")
def grant_authorization(spark, d):
    """Grants that hold: live, and delegated by a chain of live grants from a root."""
    g = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") > 1, F.expr("s_suppkey div 2")).alias("parent"), (F.col("s_suppkey") % 7 != 0).alias("live"))
    live = g.where("live")
    edges = live.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    return lineage.reach(edges, live.where("parent is null").select(F.col("id").alias("node"))).select(F.col("node").alias("id")).distinct()


@query("purge_impact", """SELECT DISTINCT o_orderkey AS source, 'line' AS kind, l_orderkey * 10 + l_linenumber AS object FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 50 = 0
UNION SELECT o_orderkey, 'part', l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 50 = 0""")
def purge_impact(spark, d):
    """The dependent set of erased sources: derived rows and what they cite."""
    o = load(spark, d, "orders").where("o_custkey % 50 = 0").select("o_orderkey")
    j = o.join(load(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = F.array(F.struct(F.lit("line").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("object")), F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("object")))
    return j.select(F.col("o_orderkey").alias("source"), F.explode(both).alias("x")).select("source", "x.kind", "x.object").distinct()


@query("state_transitions", """WITH t AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT event_id, CASE WHEN prev IS NULL THEN 'opened' WHEN prev = 'error' AND event_type <> 'signup' THEN 'refused' ELSE 'accepted' END AS verdict FROM t""")
def state_transitions(spark, d):
    """Guarded compare-and-set: after an error only a signup is a legal next state."""
    prev = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    v = F.when(F.col("prev").isNull(), "opened").when((F.col("prev") == "error") & (F.col("event_type") != "signup"), "refused").otherwise("accepted")
    return load(spark, d, "events").withColumn("prev", prev).select("event_id", v.alias("verdict"))


@query("freshness", """SELECT event_id, CASE WHEN ts + to_days((value::INTEGER % 20)::INTEGER) < TIMESTAMP '2024-01-20' THEN 'stale' ELSE 'fresh' END AS state FROM events WHERE value < 1000""")
def freshness(spark, d):
    """A deadline of value mod 20 days against a fixed clock; value rounds half to even."""
    days = F.bround("value").cast("int") % 20
    stale = F.col("ts").cast("timestamp_ltz") + F.make_interval(days=days) < F.lit("2024-01-20").cast("timestamp_ltz")
    return load(spark, d, "events").where("value < 1000").select("event_id", F.when(stale, "stale").otherwise("fresh").alias("state"))


@query("overdue", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'overdue' WHEN o_orderstatus = 'O' THEN 'due' ELSE 'done' END AS state FROM orders")
def overdue(spark, d):
    late = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return load(spark, d, "orders").select("o_orderkey", F.when(late, "overdue").when(F.col("o_orderstatus") == "O", "due").otherwise("done").alias("state"))


@query("blast_radius", "SELECT k AS recipient, count(*) AS n FROM (SELECT DISTINCT l_suppkey AS k, l_orderkey AS o FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_custkey + 1000000, o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def blast_radius(spark, d):
    a = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("recipient"), F.col("l_orderkey").alias("o"))
    b = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey") + 1000000, "o_orderkey")
    return a.union(b).distinct().groupBy("recipient").agg(F.count(F.lit(1)).alias("n"))


@query("standing_query_dirty", """WITH c AS (SELECT DISTINCT event_type, user_id % 10 AS shard FROM events WHERE event_id > 900),
s AS (SELECT n_nationkey AS sq, CASE n_nationkey % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'view' ELSE 'purchase' END AS want, n_nationkey % 10 AS shard FROM nation)
SELECT sq, EXISTS (SELECT 1 FROM c WHERE c.event_type = s.want AND c.shard = s.shard) AS dirty FROM s""")
def standing_query_dirty(spark, d):
    """A stored query is dirty unless its filters exclude every changed row."""
    changed = load(spark, d, "events").where("event_id > 900").select(F.col("event_type").alias("want"), (F.col("user_id") % 10).cast("int").alias("shard")).distinct().withColumn("hit", F.lit(True))
    k = F.col("n_nationkey")
    want = F.when(k % 4 == 0, "click").when(k % 4 == 1, "error").when(k % 4 == 2, "view").otherwise("purchase")
    s = load(spark, d, "nation").select(k.alias("sq"), want.alias("want"), (k % 10).alias("shard"))
    return s.join(changed, ["want", "shard"], "left").select("sq", F.coalesce("hit", F.lit(False)).alias("dirty"))


@query("deletion_closure", """WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey >= 3),
r AS (SELECT 5::BIGINT AS node, 0 AS depth UNION SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.node) SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY 1""")
def deletion_closure(spark, d):
    e = load(spark, d, "part").where("p_partkey >= 3").select(F.expr("p_partkey div 3").alias("src"), F.col("p_partkey").alias("dst"))
    return lineage.reach(e, spark.range(1).select(F.lit(5).cast("long").alias("node"))).select("node", "depth")


CAPTURED = "(-1, NULL, 'a'), (-2, NULL, 'b'), (-3, 's', NULL), (-4, 's', NULL), (-5, NULL, 'a'), (-6, 'null', 'a')"


@query("idempotent_capture", f"""WITH c AS (SELECT doc_id, source, text FROM documents UNION ALL SELECT * FROM (VALUES {CAPTURED}) AS v(doc_id, source, text))
SELECT min(doc_id) AS receipt, count(*) AS submissions, sha256(coalesce('=' || source, 'null') || chr(31) || coalesce('=' || text, 'null')) AS key FROM c GROUP BY source, text""")
def idempotent_capture(spark, d):
    """Resubmissions of one (origin, content) collapse onto the first receipt; a null part equals only another null."""
    more = spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, source, text FROM VALUES {CAPTURED} AS v(doc_id, source, text)")
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    key = F.sha2(F.concat(part(F.col("source")), F.lit("\x1f"), part(F.col("text"))).cast("binary"), 256)
    both = load(spark, d, "documents").select("doc_id", "source", "text").unionByName(more)
    return both.groupBy(key.alias("key")).agg(F.min("doc_id").alias("receipt"), F.count(F.lit(1)).alias("submissions"))
