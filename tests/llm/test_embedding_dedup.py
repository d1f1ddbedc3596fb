import numpy as np

from loomwork.llm import embedding_dedup as ed
from loomwork.llm import vectors


def brute(vecs, least):
    v = np.array(vecs, np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    m = u @ u.T >= least
    np.fill_diagonal(m, False)
    comp = list(range(len(v)))
    changed = True
    while changed:
        changed = False
        for i in range(len(v)):
            low = min([comp[i], *(comp[j] for j in np.flatnonzero(m[i]))])
            if low < comp[i]:
                comp[i], changed = low, True
    return m.sum(1), comp


def data(seed=0, n=300, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    v = np.concatenate([centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.25, np.repeat(centres[:1], 40, 0), centres[0] + rng.normal(size=(80, d)) * 0.02])
    return v.astype(np.float32)


def test_equals_brute_force(spark):
    v = data()
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, id int")
    n, comp = brute(v, 0.95)
    for r in ed.near_duplicates(df).collect():
        assert (r.n_links, r.component, r.kept) == (n[r.id], comp[r.id], comp[r.id] == r.id)


def test_small_tiles_change_nothing(spark):
    from loomwork.scratch import Scratch

    v = data(1)
    own = vectors.prepare(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    cls = own.selectExpr("id", "1L as n", "vec")
    for tile in (7, 4096):
        got = ed.links(cls, Scratch(spark, "t"), 0.95, tile=tile).where("not edge").groupBy("u").sum("v").collect()
        n, _ = brute(v, 0.95)
        assert {r[0]: r[1] for r in got} == {i: c for i, c in enumerate(n) if c}


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (9, []), (10, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [3.0]), (2**60 + 1, [0.0, 1.0]), (2**60 + 3, [0.0, 2.0]), (None, [0.0, 3.0])]
    out = {r.id: (r.n_links, r.component, r.kept) for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert out[1] == (2, 1, True) and out[2] == (2, 1, False) and out[10] == (2, 1, False)
    assert all(out[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 9, 11)) and len(out) == 15
    assert out[8] == (1, 8, True) and out[12] == (1, 8, False)  # of length one: compared with each other
    # ids beyond 2^53 keep every bit; a row without an id links with nothing
    assert out[2**60 + 1] == (1, 2**60 + 1, True) and out[2**60 + 3] == (1, 2**60 + 1, False) and out[None] == (0, None, True)
    assert ed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_grid_refines_with_the_rows():
    moments = np.diag([0.4, 0.3, 0.2, 0.05, 0.05])
    eps = 0.3
    few, many = ed.leading_dims(moments * 1e4, 10**4, eps, 4096), ed.leading_dims(moments * 1e9, 10**9, eps, 4096)
    assert 1 <= few < many <= 5


def test_query(spark, sf):
    out = ed.op10_embedding_dedup(spark, sf).toPandas().set_index("vec_id").sort_index()
    raw = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().set_index("vec_id").sort_index()
    n, comp = brute(np.stack(raw.embedding), 0.95)
    assert (out.n_links.to_numpy() == n).all() and (out.component_id.to_numpy() == raw.index.to_numpy()[comp]).all()


def test_vectors_move_once_whatever_the_pairs_of_tiles(spark):
    """Sixty-odd tiles in one another's reach: before, a vector was shuffled to each of their pairs."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], "id long, n long, vec array<float>")
    written = lambda: sum(e.totalShuffleWrite() for e in _executors(spark))
    before = written()
    from loomwork.scratch import Scratch

    out = ed.links(rows, Scratch(spark, "t"), 0.5, tile=64, leading=1).where("not edge").groupBy("u").sum("v").collect()
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    n = (u @ u.T >= 0.5).sum(1) - 1
    assert {r[0]: r[1] for r in out} == {i: k for i, k in enumerate(n.tolist()) if k}
    assert written() - before < 3 * v.nbytes


def _executors(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return [found.apply(i) for i in range(found.size())]


def test_copies_far_apart_become_one_class(spark):
    v = np.random.default_rng(6).normal(size=(50, 16)).astype(np.float32)
    rows = [(1000 * k + i, x.tolist()) for k in range(40) for i, x in enumerate(v)]
    out = ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(20)).collect()
    assert len(out) == 2000 and all(r.n_links == 39 and r.component == r.id % 1000 for r in out)
