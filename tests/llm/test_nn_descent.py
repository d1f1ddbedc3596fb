import numpy as np
import pytest

from loomwork.llm import nn_descent as nn
from loomwork.scratch import Scratch


def vectors(n, dims, seed=1, centres=0, spread=0.1, offset=0.0):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dims))
    if centres:
        v = r.normal(size=(centres, dims))[r.integers(0, centres, n)] + spread * v
    return (v + offset).astype(np.float32)


def table(spark, v, kind="float", step=1):
    return spark.createDataFrame([(i * step, x.tolist()) for i, x in enumerate(v)], f"vec_id long, embedding array<{kind}>")


def recall(out, v, top=10):
    v = v.astype(np.float64)
    hit = total = 0
    for q, g in out.groupby("query_id"):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, top + 1))
        assert sorted(zip(g.score, g.id)) == list(zip(g.score, g.id))
        assert np.abs(g.score.to_numpy() - d[g.id]).max() < 1e-12
        hit += len(set(np.lexsort((np.arange(len(v)), d))[:top]) & set(g.id))
        total += top
    return hit / total


def test_the_query_finds_nine_tenths(spark):
    """The registered query, against brute force over all of sf0.1."""
    folder = "/root/testdata/sf0.1"
    raw = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values("vec_id")
    assert raw.vec_id.tolist() == list(range(len(raw)))
    out = nn.op9_nn_descent(spark, folder).toPandas().rename(columns={"vec_id": "id"})
    assert set(out.query_id) == set(range(0, len(raw), 100))
    assert recall(out, np.stack(raw.embedding)) >= 0.9


def graph_recall(spark, v, rounds, k=16):
    nodes = table(spark, v).select("vec_id", "embedding").toDF("id", "vec")
    g = nn.build(nodes, Scratch(spark, "t"), k=k, reverse=16, trees=2, leaf=24, block=512, rounds=rounds).toPandas()
    x = v.astype(np.float64) - v.mean(0)
    d = (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    true = np.argpartition(d, k - 1, axis=1)[:, :k]
    return sum(len(set(true[u]) & set(n)) for u, n in zip(g.u, g.next)) / true.size


def test_descent_makes_the_graph(spark):
    v = vectors(2000, 16)
    poor, fair = graph_recall(spark, v, 0), graph_recall(spark, v, 8)
    assert poor < 0.3 and fair > 0.85, (poor, fair)


@pytest.mark.parametrize("v", [vectors(1200, 16, 2, 30, 1e-4), vectors(1200, 16, 3, offset=100.0), vectors(1200, 16, 4) * np.float32(1e6)], ids=["tight", "offset", "large"])
def test_clusters_offsets_and_scale(spark, v):
    out = nn.neighbours(table(spark, v), 50).toPandas()
    assert recall(out, v) >= 0.9


def test_defined_results(spark):
    nan = float("nan")
    rows = [(100 * i, [1.0, float(i)]) for i in range(4)] + [(7, [1.0, 1.0]), (8, [1.0, 1.0]), (500, None), (600, [nan, 1.0]), (700, [0.0, 0.0]), (9, [1.0, None]), (None, [1.0, 1.5])]
    rows += [(800, [5.0]), (801, [7.0]), (802, [4.5]), (900, [])]  # another length: another graph
    out = nn.neighbours(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, query_id string"), 100).toPandas()
    got = {q: list(zip(g.sort_values("rank").id, g.sort_values("rank").score)) for q, g in out.groupby("query_id")}
    assert set(got) == {0, 100, 200, 300, 800}
    assert got[100] == [(7, 0.0), (8, 0.0), (0, 1.0), (200, 1.0), (300, 2.0)]
    assert got[800] == [(802, 0.5), (801, 2.0)]
    assert nn.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), 100).count() == 0


def test_one_vector_for_a_third(spark):
    v = np.random.default_rng(3).normal(size=(200, 8))
    rows = [(i, v[i].tolist()) for i in range(200)] + [(1000 + i, v[0].tolist()) for i in range(100)]
    out = nn.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100).toPandas()
    g = out[out.query_id == 0].sort_values("rank")
    assert g.id.tolist() == list(range(1000, 1010)) and (g.score == 0).all()
    g = out[out.query_id == 1000].sort_values("rank")
    assert g.id.tolist() == [0, *range(1001, 1010)]
