from difflib import SequenceMatcher

from pyspark.sql import functions as F

from loomwork.operators import sieve


def test_events_and_antecedents(spark):
    rows = [(0, 1, 0, "Mia", "Last week I bought a boat"), (1, 1, 1, "Mia", "yesterday Tom never met Zoe"), (2, 1, 2, None, "I left home"), (3, 1, 3, "Mia", "did she say so"), (4, 1, 4, "Mia", "now Tom again"), (5, 2, 0, "Mia", "he ran"), (6, 1, 5, "Mia", None)]
    u = spark.createDataFrame(rows, "unit_id int, session_id int, seq int, speaker string, text string")
    got = {(r.unit_id, r.subject, r.family, r.object, r.negated) for r in sieve.events(u).collect()}
    assert got == {(0, "mia", "acquire", "boat", False), (1, "tom", "meet", "zoe", True)}
    # unit 3 has Tom and Zoe before it, unit 5 nobody: both abstain
    assert {r.unit_id: r.antecedent for r in sieve.antecedents(u).collect()} == {3: None, 5: None}
    assert {r.unit_id: r.antecedent for r in sieve.antecedents(u.where("unit_id <> 1").union(spark.createDataFrame([(9, 1, 1, "Mia", "so Tom is in")], u.schema))).collect()} == {3: "Tom", 5: None}


def test_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), (None, "x"), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for (a, b), r in zip(pairs, df.select(sieve.ratio("a", "b").alias("r")).collect()):
        assert r.r == (None if a is None else SequenceMatcher(None, a, b, autojunk=False).ratio())


def test_repair_equals_rebuild(spark):
    total = lambda x: x.groupBy("k").agg(F.sum("v").alias("s"))
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], "k string, v int")
    changed = spark.createDataFrame([("b",), ("c",), ("d",)], "k string")
    got = {(r.k, r.s) for r in sieve.repair(total(old), new, changed, ["k"], total).collect()}
    assert got == {("a", 1), ("b", 5), ("d", 4)}
