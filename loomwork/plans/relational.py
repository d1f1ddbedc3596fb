"""Registered relational coverage over the star schema, and filter compilers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators.filters import consumer_filter, predicate_tree
from loomwork.plans.registry import load, query


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    l = load(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"),
    )


@query("star_join", """SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def star_join(spark, d):
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    l = load(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return l.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi_join(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "orders").where("o_orderstatus = 'O'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def anti_join(spark, d):
    urgent = load(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return load(spark, d, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("left_outer_join", "SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_outer_join(spark, d):
    j = load(spark, d, "customer").join(load(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query("full_outer_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS n_cust, b.n AS n_supp FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def full_outer_join(spark, d):
    a = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_cust"))
    b = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_supp"))
    return a.join(b, "k", "full")


@query("conditional_aggregate", "SELECT o_custkey, min(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS first_done, count(*) FILTER (WHERE o_totalprice > 100000) AS n_large FROM orders GROUP BY 1")
def conditional_aggregate(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("first_done"), F.count_if(F.col("o_totalprice") > 100000).alias("n_large"))


@query("having_filter", "SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 300")
def having_filter(spark, d):
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty")).where("qty > 300")


@query("cube_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::INTEGER AS g1, grouping(l_linestatus)::INTEGER AS g2 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_aggregate(spark, d):
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))


@query("pivot_outcomes", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1")
def pivot_outcomes(spark, d):
    kinds = ["click", "error", "view"]
    e = load(spark, d, "events").where(F.col("event_type").isin(kinds))
    return e.groupBy("user_id").pivot("event_type", kinds).count().fillna(0, kinds)


@query("set_intersection", "SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def set_intersection(spark, d):
    e = load(spark, d, "events")
    return e.where("event_type = 'signup'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@query("set_difference", "SELECT l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 45")
def set_difference(spark, d):
    l = load(spark, d, "lineitem").where("l_quantity >= 45")
    return l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p")).subtract(l.where("l_returnflag = 'A'").select("l_partkey"))


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, d, "supplier").select("s_nationkey")).distinct()


@query("rank_cap", "SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def rank_cap(spark, d):
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", r.cast("long").alias("r")).where("r <= 3")


@query("running_window", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, rank() OVER v AS rnk, dense_rank() OVER v AS dense, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def running_window(spark, d):
    w, v = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), W.partitionBy("o_custkey").orderBy("o_orderpriority")
    return load(spark, d, "orders").select(
        "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"), F.rank().over(v).cast("long").alias("rnk"), F.dense_rank().over(v).cast("long").alias("dense"), F.ntile(4).over(w).cast("long").alias("quarter")
    )


@query("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def top_k(spark, d):
    return load(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("consumer_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def consumer_filter_query(spark, d):
    f = {"event_type": ["click", "view"], "created_after": "2024-01-05", "created_before": "2024-01-10"}
    return load(spark, d, "events").where(consumer_filter(f, {"event_type", "user_id"}, "ts")).select("event_id")


@query("predicate_tree", "SELECT event_id FROM events WHERE value >= 10 AND value < 50 AND event_type = 'click' AND user_id IN (1, 2, 3, 5, 8)")
def predicate_tree_query(spark, d):
    tree = {"AND": [{"value": {"gte": 10, "lt": 50}}, {"event_type": "click"}, {"user_id": {"in": [1, 2, 3, 5, 8]}}]}
    return load(spark, d, "events").where(predicate_tree(tree)).select("event_id")


@query("substring_join", "SELECT p_partkey, n_name FROM part JOIN nation ON contains(lower(p_name || ' ' || p_type || ' ' || p_brand || '|'), right(n_name, 1) || '|')")
def substring_join(spark, d):
    """Theta-join against a table of fixed size (nation), which is broadcast."""
    p = load(spark, d, "part").select("p_partkey", F.concat(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), F.lit("|")).alias("t"))
    n = F.broadcast(load(spark, d, "nation").select("n_name", F.concat(F.right("n_name", F.lit(1)), F.lit("|")).alias("needle")))
    return p.join(n, F.contains("t", "needle")).select("p_partkey", "n_name")
