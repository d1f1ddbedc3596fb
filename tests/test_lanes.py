"""Lanes over vectors and texts on stated rows."""

import time

import numpy as np

from loomwork.operators import retrieval as R
from loomwork.operators.nearest import cosine_nearest
from loomwork.plans import registry


def test_codes_use_the_whole_scale(spark, tmp_path):
    # 88.5000001 steps of the scale, 88.49999 of the rounded one
    top = 127 * 0.0027754186
    rows = [(1, [top, top * 88.5000001 / 127])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = registry.QUERIES["int8_quantize"](spark, str(tmp_path)).collect()
    assert [(r.scale, r.code_sum) for r in out] == [(0.002775419, 127 + 89)]


def test_many_distinct_users_are_counted_exactly(spark, tmp_path):
    e = spark.range(300_000).selectExpr("id AS event_id", "timestamp_micros(id * 1000000) AS ts", "if(id % 3 = 0, null, id * 7919) AS user_id", "if(id % 2 = 0, 'a', 'b') AS event_type")
    e.union(e).union(spark.sql("SELECT -1L, timestamp_micros(0L), CAST(null AS BIGINT), 'none'")).write.parquet(f"{tmp_path}/events.parquet")
    out = registry.QUERIES["sketched_counts"](spark, str(tmp_path)).collect()
    assert {r.event_type: r.users for r in out} == {"a": 100_000, "b": 100_000, "none": 0}


def test_needles_in_a_long_text(spark, tmp_path):
    """A text of a million characters, whose 8-grams would take a substring from its start each."""
    long = "abñ\U0001f600" * 250_000 + "needle:x"
    docs = [(1, long), (2, "x needle:x"), (2, "needle:x needle:x"), (3, "needle:"), (4, None), (5, "")]
    items = [(1, "0123456789needle:x"), (2, "0123456789" + "ñ\U0001f600ab" * 2), (3, "short"), (4, None), (5, "0123456789needle:x!")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    start = time.monotonic()
    out = registry.QUERIES["substring_lane"](spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.doc_id) for r in out) == [(1, 1), (1, 2), (1, 2), (2, 1), (5, 1), (5, 2), (5, 2)]
    assert time.monotonic() - start < 30


def test_nearest_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).round(1)
    v[200:] = v[:100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0]), (904, [None] + [1.0] * 7), (905, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in cosine_nearest(e, e.where("vec_id % 20 = 0 or vec_id > 899"), 10).collect():
        got.setdefault(r.qid, []).append((r.score is not None, np.inf if r.score is not None and np.isnan(r.score) else r.score or 0.0, -r.unit_id))
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    for qid in [*range(0, 300, 20), *range(900, 906)]:
        want = []
        for i, x in rows:
            if i == qid:
                continue
            q = dict(rows)[qid]
            if not q or not x or len(q) != len(x) or None in q or None in x:
                want.append((False, 0.0, -i))
            elif {qid, i} & {901, 902}:
                want.append((True, np.inf, -i))
            else:
                want.append((True, round(float(unit(q) @ unit(x)), 6), -i))
        best = sorted(got[qid], reverse=True)[:10]
        assert [(a, c) for a, _, c in best] == [(a, c) for a, _, c in sorted(want, reverse=True)[:10]]
        assert np.allclose([b for _, b, _ in best], [b for _, b, _ in sorted(want, reverse=True)[:10]])


def test_respelling_counts_bytes(spark):
    terms = spark.createDataFrame([(1, "nachte"), (1, "rscho")], "qid int, term string")
    vocabulary = spark.createDataFrame([(t,) for t in ("\u00dfachte", "aachie", "nachts", "\u00dfscho", "rschu", "\u00df\u00dfchte")], "term string")
    got = {(r.term, r.near, r.distance) for r in R.fuzzy_terms(terms, vocabulary).collect()}
    assert got == {("nachte", "\u00dfachte", 2), ("nachte", "aachie", 2), ("nachte", "nachts", 1), ("rscho", "rschu", 1)}
