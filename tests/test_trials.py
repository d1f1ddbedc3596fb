from math import comb

import numpy as np
from pyspark.sql import functions as F

from loomwork.functions import markers, trials


def test_mcnemar_is_exact(spark):
    pairs = [(0, 0), (1, 0), (3, 9), (9, 3), (40, 60), (2000, 2100)]
    df = spark.createDataFrame(pairs, "b long, c long")
    got = [r.p for r in df.select(trials.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()]
    for (b, c), p in zip(pairs, got):
        n = b + c
        want = min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0
        assert abs(p - want) < 1e-9


def test_bootstrap_matches_theory_and_seed(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 2, 4000)
    df = spark.createDataFrame([("a", int(v)) for v in x] + [("b", 1), ("b", 1), ("c", None)], "k string, v int")
    out = {r.k: r for r in trials.paired_bootstrap(df, "k", "v").collect()}
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert set(out) == {"a", "b"} and out["b"].low == out["b"].high == 1.0
    assert abs(out["a"].mean - x.mean()) < 1e-12
    assert abs((out["a"].high - out["a"].low) / 2 - half) < 0.1 * half
    assert {r.k: r for r in trials.paired_bootstrap(df, "k", "v").collect()} == out


def test_polarity_order(spark):
    texts = {
        'she wrote "it never broke"': "quoted", "if it does not run, stop": "hypothetical", "whether or not it ran": "hedged", "we don't think it broke": "hedged",
        "it never ran": "negated", "maybe later": "hedged", "please check that it runs": "hedged", "ruff check": "affirmative", None: "affirmative", "": "affirmative",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.p for r in df.select(markers.polarity(F.col("t")).alias("p")).collect()] == list(texts.values())
    kinds = {"I no longer like tea": "preference", "we decided to ship": "decision", "she manages to sleep": "untyped", "she manages ops": "relationship", None: "untyped"}
    df = spark.createDataFrame([(t,) for t in kinds], "t string")
    assert [r.p for r in df.select(markers.memory_type(F.col("t")).alias("p")).collect()] == list(kinds.values())


def test_markers_are_bounded_by_ascii_words(spark):
    """As in the SQL: letters beyond ASCII, no-break spaces and vertical tabs are neither words nor white space."""
    texts = {"No\u00f1as": "negated", "\u00f1no": "negated", "nos": "affirmative", "no_": "affirmative", "in\u00a0case": "affirmative", "in\x0bcase": "affirmative", "in\tcase": "hypothetical", "ask\rthat": "hedged"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.p for r in df.select(markers.polarity(F.col("t")).alias("p")).collect()] == list(texts.values())


def test_guards_see_ascii_words(spark):
    pairs = [("No\u00f1as 3", "yes 3", False), ("No\u00f1as 3", "no 3", True), ("as\u00f1 3", "es\u00f1 3", True)]
    df = spark.createDataFrame(pairs, "a string, b string, may boolean")
    assert all(r.may == r.got for r in df.select("may", markers.same_guards(F.col("a"), F.col("b")).alias("got")).collect())
