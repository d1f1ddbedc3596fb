"""Registered versioning, sharing, scheduling and repair queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators import temporal
from loomwork.plans.registry import load, query

# A branch of proposed operations over orders: some rows are dropped, some repriced, some added.
OPS = """ops AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' ELSE 'insert' END AS op,
 CASE o_orderkey % 3 WHEN 2 THEN o_orderkey + 100000000 ELSE o_orderkey END AS key, o_orderstatus AS status, o_totalprice + 1 AS priority FROM orders WHERE o_custkey % 20 = 0),
base AS (SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS priority FROM orders),
head AS (SELECT * FROM base WHERE key NOT IN (SELECT key FROM ops) UNION ALL SELECT key, status, priority FROM ops WHERE op <> 'delete')"""


def _branch(spark, d):
    """(base, ops, head): head is base without the touched keys, plus what the operations leave there."""
    o = load(spark, d, "orders")
    base = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("priority"))
    m = F.col("o_orderkey") % 3
    ops = o.where("o_custkey % 20 = 0").select(
        F.when(m == 2, F.col("o_orderkey") + 100000000).otherwise(F.col("o_orderkey")).alias("key"),
        F.when(m == 0, "delete").when(m == 1, "update").otherwise("insert").alias("op"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") + 1).alias("priority"),
    )
    head = base.join(ops.select("key"), "key", "left_anti").unionByName(ops.where("op <> 'delete'").drop("op"))
    return base, ops, head


@query("branch_overlay", f"WITH {OPS} SELECT key, status, priority FROM head")
def branch_overlay(spark, d):
    return _branch(spark, d)[2]


@query("branch_diff", f"""WITH {OPS} SELECT coalesce(b.key, h.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN h.key IS NULL THEN 'removed' ELSE 'changed' END AS change, b.priority AS before, h.priority AS after
FROM base b FULL JOIN head h ON b.key = h.key WHERE b.key IS NULL OR h.key IS NULL OR b.status <> h.status OR b.priority <> h.priority""")
def branch_diff(spark, d):
    base, _, head = _branch(spark, d)
    b = base.select("key", F.struct("status", "priority").alias("b"))
    h = head.select("key", F.struct("status", "priority").alias("h"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("changed")
    return b.join(h, "key", "full").where(~F.col("b").eqNullSafe(F.col("h"))).select("key", change.alias("change"), F.col("b.priority").alias("before"), F.col("h.priority").alias("after"))


ROUTE = "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY {}) AS r FROM (SELECT user_id, event_type, count(*) AS n, max(value) AS v FROM events GROUP BY 1, 2)"


@query("replay_divergence", f"""WITH a AS (SELECT user_id, event_type FROM ({ROUTE.format('n DESC, event_type')}) WHERE r <= 2), b AS (SELECT user_id, event_type FROM ({ROUTE.format('v DESC, event_type')}) WHERE r <= 2)
SELECT user_id, event_type, 'baseline' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, event_type, 'variant' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def replay_divergence(spark, d):
    """Rows on which two routings of the same input differ: by count, and by largest value."""
    g = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    w = W.partitionBy("user_id")
    r = g.withColumn("a", F.row_number().over(w.orderBy(F.desc("n"), "event_type")) <= 2).withColumn("b", F.row_number().over(w.orderBy(F.desc("v"), "event_type")) <= 2)
    # both routings keep their decisions beside the row, so the two differences need no further shuffle
    return r.where(F.col("a") != F.col("b")).select("user_id", "event_type", F.when(F.col("a"), "baseline").otherwise("variant").alias("only_in"))


@query("handoff_view", """WITH h AS (SELECT user_id AS recipient, (user_id * 7) % 50 AS owner, max(ts) + INTERVAL 2 DAY AS expires FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT h.recipient, e.event_id FROM events e JOIN h ON e.user_id = h.owner WHERE e.event_type = 'purchase' AND h.expires > TIMESTAMP '2024-01-20' AND h.recipient <> h.owner""")
def handoff_view(spark, d):
    """What each recipient sees of its owner's purchases through capsules that have not expired."""
    e = load(spark, d, "events")
    h = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("recipient")).agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("expires"))
    h = h.where(F.col("expires") > F.lit("2024-01-20").cast("timestamp_ntz")).withColumn("owner", F.col("recipient") * 7 % 50).where("recipient <> owner")
    return e.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("owner")).join(h, "owner").select("recipient", "event_id")


@query("generation_sweep", "WITH g AS (SELECT event_id, user_id, day(ts) AS generation FROM events) SELECT generation::INTEGER AS generation, count(*) AS kept FROM g WHERE generation >= (SELECT max(generation) - 5 FROM g) GROUP BY 1")
def generation_sweep(spark, d):
    """Rows by generation that a sweep keeps: the last five generations and the current one."""
    g = load(spark, d, "events").groupBy(F.dayofmonth("ts").alias("generation")).agg(F.count(F.lit(1)).alias("kept"))
    last = g.agg((F.max("generation") - 5).alias("least"))
    return g.join(F.broadcast(last), F.col("generation") >= F.col("least")).select("generation", "kept")  # one row


@query("queue_stats", """SELECT event_type AS state, count(*) AS jobs, max(1706745600000000 - epoch_us(ts)) AS oldest_us, min(1706745600000000 - epoch_us(ts)) AS newest_us FROM events GROUP BY 1""")
def queue_stats(spark, d):
    age = F.lit(1706745600000000) - temporal.micros(F.col("ts"))
    return load(spark, d, "events").groupBy(F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("jobs"), F.max(age).alias("oldest_us"), F.min(age).alias("newest_us"))


@query("priority_dequeue", """SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts, event_id) AS turn FROM events WHERE event_type <> 'error' QUALIFY turn <= 100""")
def priority_dequeue(spark, d):
    """The next hundred jobs by lane, then due time; the limit is the feature."""
    lane = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    e = load(spark, d, "events").where("event_type <> 'error'").select("event_id", lane.alias("lane"), "ts").orderBy("lane", "ts", "event_id").limit(100)
    return e.select("event_id", F.row_number().over(W.orderBy("lane", "ts", "event_id")).cast("long").alias("turn"))


@query("backoff_schedule", """SELECT event_id, least(300, 2 * 2 ** (attempt - 1))::BIGINT AS wait_s FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')""")
def backoff_schedule(spark, d):
    """Waits of 2, 4, 8 ... up to 300 seconds before each retry of a user's failures."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = load(spark, d, "events").where("event_type = 'error'").withColumn("n", n)
    return e.select("event_id", F.least(F.lit(300.0), F.pow(F.lit(2.0), F.col("n"))).cast("long").alias("wait_s"))


REFRESH = """j AS (SELECT user_id, count(*) AS demand, count(*) FILTER (WHERE event_type = 'error') AS stale, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS owner FROM events GROUP BY 1),
s AS (SELECT user_id, owner, demand AS cost, round((1 + stale) * (1 + demand) * 0.5 + 2.0 * stale, 6)::DOUBLE AS utility FROM j),
t AS (SELECT *, sum(cost) OVER (ORDER BY owner DESC, utility DESC, user_id ROWS UNBOUNDED PRECEDING) AS spent FROM s)"""


@query("refresh_budget", f"WITH {REFRESH} SELECT user_id, utility, owner = 1 OR spent <= 400 AS chosen FROM t WHERE owner = 1 OR spent <= 400")
def refresh_budget(spark, d):
    """Jobs by utility within a budget of 400 units; owners' jobs are never evicted.

    Every cost is at least one, so 400 of the other jobs at most can fit: the
    running sum sees the owners' total and those, never all jobs.
    """
    one = lambda t: F.count_if(F.col("event_type") == t)
    j = load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("cost"), one("error").alias("stale"), (one("signup") > 0).alias("owner"))
    s = j.select("user_id", "owner", "cost", F.round((1 + F.col("stale")) * (1 + F.col("cost")) * 0.5 + 2.0 * F.col("stale"), 6).alias("utility"))
    mine = s.where("owner")
    paid = mine.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("paid"))
    few = s.where("not owner").orderBy(F.desc("utility"), "user_id").limit(400).join(F.broadcast(paid))  # one row
    spent = F.col("paid") + F.sum("cost").over(W.orderBy(F.desc("utility"), "user_id").rowsBetween(W.unboundedPreceding, 0))
    return mine.select("user_id", "utility").union(few.withColumn("spent", spent).where("spent <= 400").select("user_id", "utility")).withColumn("chosen", F.lit(True))


@query("group_representative", """WITH g AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest, source IS NULL AS superseded FROM documents)
SELECT digest, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY superseded, doc_id) AS r, count(*) OVER (PARTITION BY digest) AS n FROM g) WHERE r = 1 AND n > 1""")
def group_representative(spark, d):
    """The earliest live member of each group of equal texts, by an aggregate that combines before the shuffle."""
    g = load(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), F.col("source").isNull().alias("superseded"))
    best = g.groupBy("digest").agg(F.min(F.struct("superseded", "doc_id")).alias("m"), F.count(F.lit(1)).alias("n"))
    return best.where("n > 1").select("digest", "m.doc_id")


@query("corroboration", """SELECT sha256(coalesce(text, '')) AS digest, count(*) AS submissions, count(DISTINCT source) AS submitters FROM documents GROUP BY 1 HAVING count(*) > 1""")
def corroboration(spark, d):
    """Resubmissions of each duplicate group, and its distinct submitters."""
    g = load(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return g.agg(F.count(F.lit(1)).alias("submissions"), F.countDistinct("source").alias("submitters")).where("submissions > 1")


@query("roots", """WITH e AS (SELECT conv_id * 4294967296 + turn AS id, lag(conv_id * 4294967296 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations)
SELECT id FROM e WHERE id NOT IN (SELECT id FROM e WHERE parent IS NOT NULL)""")
def roots(spark, d):
    """Nodes that no derivation edge enters."""
    w = W.partitionBy("conv_id").orderBy("turn")
    u = load(spark, d, "conversations").select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("id"), F.lag("turn").over(w).isNotNull().alias("derived"))
    return u.select("id").join(u.where("derived").select("id"), "id", "left_anti")


@query("contradictions", """WITH c AS (SELECT user_id AS subject, event_type AS slot, floor(value / 10)::BIGINT AS value, ts::DATE AS day FROM events), v AS (SELECT subject, slot, day, min(value) AS low, max(value) AS high, count(*) AS claims FROM c GROUP BY 1, 2, 3)
SELECT subject, slot, epoch_us(day::TIMESTAMP) AS day_us, low, high, claims FROM v WHERE low <> high""")
def contradictions(spark, d):
    """Slots for which one day's claims disagree."""
    c = load(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("slot"), F.floor(F.col("value") / 10).cast("long").alias("value"), F.date_trunc("day", "ts").alias("day"))
    v = c.groupBy("subject", "slot", "day").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("claims")).where("low <> high")
    return v.select("subject", "slot", temporal.micros(F.col("day")).alias("day_us"), "low", "high", "claims")


@query("applicability", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND c_acctbal > 0 THEN 'true' WHEN o_orderstatus <> 'F' OR c_acctbal <= 0 THEN 'false' ELSE 'unknown' END AS applies FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_custkey""")
def applicability(spark, d):
    """Three-valued: unknown where a needed binding is missing and nothing else decides."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer").where("c_custkey % 3 > 0")
    test = (F.col("o_orderstatus") == "F") & (F.col("c_acctbal") > 0)
    return o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", F.coalesce(test.cast("string"), F.lit("unknown")).alias("applies"))


@query("procedure_signature", """WITH s AS (SELECT user_id, ts::DATE AS day, string_agg(event_type, '>' ORDER BY ts, event_id) AS steps FROM events GROUP BY 1, 2)
SELECT sha256(steps) AS signature, count(*) AS episodes, count(DISTINCT user_id) AS users FROM s GROUP BY 1""")
def procedure_signature(spark, d):
    """Digest of each user-day's ordered steps, with how often it recurs."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    s = load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(steps, ">").alias("steps"))
    return s.groupBy(F.sha2(F.col("steps").cast("binary"), 256).alias("signature")).agg(F.count(F.lit(1)).alias("episodes"), F.countDistinct("user_id").alias("users"))
