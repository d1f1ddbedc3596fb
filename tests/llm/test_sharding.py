import zlib

from loomwork.llm import sharding


def check(rows, shards, spark, schema="doc_id long, text string, shard string"):
    df = spark.createDataFrame(rows, schema)
    out = sharding.shard(df, shards=shards).toPandas()
    assert sorted(out["id"].dropna()) == sorted(r[0] for r in rows if r[0] is not None)
    n = out.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert n.max() - n.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    by = {r[0]: r[1] for r in rows}
    for r in out.dropna(subset=["id"]).itertuples():
        raw = (by[int(r.id)] or "").encode()
        assert r.size == len(raw) + 16 and r.crc == zlib.crc32(raw)
    return out.assign(text=[by.get(i) for i in out["id"]])


def test_groups_stay_together(spark):
    rows = [(i, f"text {i}", None) for i in range(400)] + [(1000 + i, f"copy {i % 20}", "x") for i in range(100)]
    out = check(rows, 10, spark)
    copies = out[out["id"] >= 1000].groupby("text").shard.nunique()
    assert (copies == 1).mean() >= 0.9


def test_a_third_in_one_group(spark):
    rows = [(i, f"text {i}", None) for i in range(400)] + [(1000 + i, "same", "x") for i in range(200)]
    out = check(rows, 12, spark)
    assert out[out.text == "same"].shard.nunique() <= 6  # 4 shards hold it at best


def test_nulls_empties_repeats_ties(spark):
    rows = [(i, None, None) for i in range(7)] + [(i + 10, "", None) for i in range(7)] + [(None, "é" * 10, "q")] * 3 + [(30, "long " * 50000, None)]
    check(rows, 4, spark)


def test_fewer_rows_than_shards_and_empty(spark):
    check([(1, "a", None), (2, "a", None)], 40, spark)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    q = sharding.op3_shard_label_propagation(spark, sf)
    assert "Python" not in q._jdf.queryExecution().toString()
    out = q.toPandas()
    assert out["shard"].between(0, 39).all() and (out["law"] == "rows").all() and out["grown_shard"].isna().all()


def test_cut_against_no_propagation(spark):
    """Cut links counted pair by pair: propagation leaves a small part of what the starting shards cut."""
    import collections
    import itertools

    rows = [(i, f"text {i // 4}" if i < 800 else f"alone {i}") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {}
    for rounds in (0, 24):
        at = {r.id: r.shard for r in sharding.shard(df, shards=8, rounds=rounds).collect()}
        size = collections.Counter(at.values())
        assert len(at) == 2400 and max(size.values()) - min(size.values()) <= 1
        cut[rounds] = sum(at[i] != at[j] for a in range(0, 800, 4) for i, j in itertools.combinations(range(a, a + 4), 2))
    assert cut[0] > 900 and cut[24] < 0.1 * cut[0], cut


def test_null_and_repeated_ids(spark):
    rows = [(None, f"t{i}") for i in range(100)] + [(7, f"u{i}") for i in range(100)] + [(None, None)] * 3
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).toPandas()
    size = out.groupby("shard").size()
    assert len(out) == 203 and size.max() - size.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
