import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwork.engine import Engine
from loomwork.operators import filters, lineage, packing, retrieval, temporal
from loomwork.sources import files
from loomwork.streaming import incremental


def test_life_of_a_unit(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.units().count() == 0
    e.ingest(spark.createDataFrame([(1, 1, 0, "ann", "red apple pie"), (2, 1, 1, "bob", "green pear")], "unit_id long, session_id long, seq long, speaker string, text string"))
    e.ingest(spark.createDataFrame([(2, "yellow pear tart"), (3, None)], "unit_id long, text string"))
    assert [r.unit_id for r in e.search("pear").collect()] == [2]
    assert e.search("green").count() == 0 and e.search("green", as_of=1).count() == 1
    e.forget(spark.createDataFrame([(1,)], "unit_id long"))
    assert e.search("apple").count() == 0 and e.status().first().units == 2
    e.ingest(spark.createDataFrame([(1, "apple again")], "unit_id long, text string"))
    assert e.search("apple").first().text == "apple again"


def test_failed_ingest_is_never_seen(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "store"))
    row = lambda t: spark.createDataFrame([(1, t)], "unit_id long, text string")
    assert e.ingest(row("old words"), key="a") == 1
    with monkeypatch.context() as m:
        m.setattr(e, "_commit", lambda g, key: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            e.ingest(row("torn words"))
    assert e.units().first().text == "old words" and e.search("torn").count() == 0
    assert e.ingest(row("ignored"), key="a") == 1 and e.units().first().text == "old words"
    g = e.ingest(row("new words"), key="b")
    assert g == 3 and e.search("new").first().unit_id == 1 and e.search("old").count() == 0
    assert e.search("old", as_of=2).count() == 1
    e.forget(spark.createDataFrame([(1,)], "unit_id long"))
    assert [(r.event, r.text) for r in e.inspect(1).collect()] == [("stored", "old words"), ("stored", "new words"), ("erased", None)]


def test_backup(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.ingest(spark.createDataFrame([(1, "one"), (2, "two")], "unit_id long, text string"))
    e.forget(spark.createDataFrame([(1,)], "unit_id long"))
    copy = e.backup(str(tmp_path / "copy"))
    assert [r.text for r in copy.units().collect()] == ["two"] and copy.search("two").count() == 1
    with pytest.raises(ValueError):
        e.backup(str(tmp_path / "copy"))


def test_pack_equals_a_plain_loop(spark):
    rows = [(q, q * 100 + r, r, (r * 37 + q * 11) % 90 + 1) for q in range(4) for r in range(1, 30)]
    got = {(r.qid, r.unit_id) for r in packing.pack(spark.createDataFrame(rows, "qid long, unit_id long, rank int, tokens long"), 300).collect()}
    want = set()
    for q in range(4):
        used = 0
        for _, u, _, t in (r for r in rows if r[0] == q):
            if used + t <= 300:
                used += t
                want.add((q, u))
    assert got == want


def test_reach_survives_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src long, dst long")
    s = spark.createDataFrame([(1,), (9,)], "node long")
    assert {(r.seed, r.node, r.depth) for r in lineage.reach(e, s).collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (9, 9, 0)}


def test_filters_refuse_what_they_do_not_know(spark):
    with pytest.raises(KeyError):
        filters.consumer_filter({"nope": 1}, {"kind"}, "ts")
    for bad in ({"OR": []}, {"a": {"ne": 1}}, {"a": {"contains": "x"}}):
        with pytest.raises(NotImplementedError):
            filters.predicate_tree(bad)


def test_fuzzy_is_exact(spark):
    import itertools
    import random

    r = random.Random(0)
    vocab = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(150)})
    terms = ["".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(40)]
    got = retrieval.fuzzy_terms(spark.createDataFrame([(0, t) for t in set(terms)], "qid long, term string"), spark.createDataFrame([(v,) for v in vocab], "term string"), most=1000)
    got = {(x.term, x.near) for x in got.collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = list(itertools.accumulate(zip(row[1:], row, b), lambda left, x: min(left + 1, x[0] + 1, x[1] + (c != x[2])), initial=i))
        return row[-1]

    want = {(t, v) for t in set(terms) - set(vocab) for v in vocab if lev(t, v) <= (1 if len(t) <= 5 else 2)}
    assert got == want


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.bin").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.text_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.md"} and rows["a.txt"].text == "héllo" and not rows["b.md"].ok


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 7)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 10, 1.5), ("a", 6, 0.5), ("c", 1, 9.0)], "k string, t long, v double")
    assert {(r.id, r.v2) for r in temporal.asof(left, right, "k", "t", "v", "v2").collect()} == {(1, 1.5), (2, None), (3, None)}


def test_session_windows(spark):
    ts = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:29", "2024-01-01 01:00", "2024-01-01 01:29"])
    df = spark.createDataFrame([("u", t.to_pydatetime()) for t in ts], "k string, ts timestamp")
    assert sorted(r.n for r in incremental.session_counts(df, "k", "ts").collect()) == [2, 2]
    assert temporal.sessions(df, "k", "ts").agg(F.max("session_no")).first()[0] == 2
