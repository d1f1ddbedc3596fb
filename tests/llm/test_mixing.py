import collections
import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomwork.llm import mixing


def received(blocks, weights, t):
    """What each source has received after t slots of the fractional schedule, worked out step by step."""
    left, got = [Fraction(n) for n in blocks], [Fraction(0)] * len(blocks)
    t = Fraction(t)
    while t > 0 and any(left):
        live = [i for i, n in enumerate(left) if n]
        total = sum(Fraction(weights[i]) for i in live)
        step = min(t, *(left[i] * total / Fraction(weights[i]) for i in live))
        for i in live:
            x = step * Fraction(weights[i]) / total
            got[i] += x
            left[i] -= x
        t -= step
    return got


@pytest.mark.parametrize("blocks,weights", [([40, 7, 30, 1], [1.0, 5.0, 2.0, 0.1]), ([30, 30, 30], [1 / 3, 1 / 3, 1 / 3]), ([50, *[2] * 25], [25, *[1] * 25]), ([5], [0.3])])
def test_lag_below_one_block_against_the_fractional_schedule(blocks, weights):
    places = mixing.schedule(blocks, weights)
    slots = sorted((t, s) for s, own in enumerate(places) for t, _ in own)
    assert [t for t, _ in slots] == list(range(sum(blocks)))
    done = collections.Counter()
    for t, s in slots:
        done[s] += 1
        for i, ideal in enumerate(received(blocks, weights, t + 1)):
            assert abs(done[i] - ideal) < 1, (t, i)


def test_300_sources_over_100000_slots_against_the_given_weights():
    r = random.Random(3)
    weights = [math.sqrt(r.randrange(1, 10**6)) for _ in range(300)]
    total = sum(weights)
    blocks = [math.ceil(100_500 * w / total) + 1 for w in weights]  # none runs dry before
    places = mixing.schedule(blocks, weights)
    for own, w in zip(places, weights):
        for i, (t, phase) in enumerate(own):
            if t < 100_000:
                # before and after its block, a source is within one block of its share
                assert phase == 0 and i + 1 - (t + 1) * w / total < 1 and t * w / total - i < 1


def test_thirds_do_not_drift(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(3000)], "doc_id long, source string")
    out = mixing.mix(df, {"s0": 1 / 3, "s1": 1 / 3, "s2": 1 / 3}, block_rows=1).orderBy("mix_slot").select("source").collect()
    done = collections.Counter()
    for t, row in enumerate(out):
        done[row.source] += 1
        assert all(abs(done[f"s{k}"] - (t + 1) / 3) < 1 for k in range(3))


def test_mix_keeps_all_rows_blocks_and_names(spark):
    rows = [(i, ["a", "b", None, ""][0 if i % 3 else i % 4], "t", 5, 1, 2, 3, 4) for i in range(900)] + [(1, "a", "t", 5, 1, 2, 3, 4)] * 3 + [(None, "a", "t", 5, 1, 2, 3, 4)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_h int, h int, g int, p_q int, mix_slot int")
    out = mixing.mix(df, block_rows=4)
    assert out.columns[:7] == ["doc_id", "source", "text", "mix_h", "h", "g", "p_q"]
    out = out.toPandas()
    assert len(out) == 905 and out["mix_position"].nunique() == 905 and out.doc_id.isna().sum() == 2
    assert sorted(out["doc_id"].dropna()) == sorted(r[0] for r in rows if r[0] is not None)
    assert (out.h == 5).sum() == 0 and set(out.mix_h) == {5} and set(out.h) == {1} and set(out.g) == {2}
    for _, g in out.groupby("mix_slot"):
        assert g.source.fillna("-").nunique() == 1 and len(g) <= 4
    first = out[out.mix_phase == 0].groupby("mix_group").mix_weight.first()
    assert abs(first.sum() - 1) < 1e-12 and out.mix_group.nunique() == 4


def test_every_source_has_its_own_weight(spark):
    df = spark.createDataFrame([(i, f"s{i % 300}") for i in range(900)], "doc_id long, source string")
    out = mixing.mix(df, {f"s{i}": i + 1 for i in range(300)}, block_rows=1).toPandas()
    assert len(out) == 900 and out.mix_group.nunique() == 300
    first = out[out.mix_phase == 0].drop_duplicates("source")
    total = 300 * 301 / 2
    assert all(abs(r.mix_weight - (int(r.source[1:]) + 1) / total) < 1e-12 for r in first.itertuples())


def test_weights_given_and_rest(spark):
    df = spark.createDataFrame([(i, f"s{i % 5}") for i in range(500)], "doc_id long, source string")
    out = mixing.mix(df, {"s0": 3, "s1": 1}, block_rows=1).toPandas()
    assert len(out) == 500 and out.mix_group.nunique() == 3 and (out.mix_group == -1).sum() == 300
    w = out[out.mix_phase == 0].groupby("mix_group").mix_weight.first()
    assert sorted(w) == [1 / 6, 2 / 6, 3 / 6]
    with pytest.raises(ValueError):
        mixing.mix(df, {"s0": 0})


def test_blocks_grow_beyond_the_slots(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}") for i in range(1000)], "doc_id long, source string")
    out = mixing.mix(df, block_rows=1, slots=100).toPandas()
    assert len(out) == 1000 and out.mix_position.nunique() == 1000
    assert out.groupby("mix_slot").size().max() == 10 and out.mix_slot.max() == out.mix_slot.nunique() - 1


def test_ties_are_settled_alike_each_time(spark):
    df = spark.createDataFrame([(i // 2, f"s{i % 2}", f"t{i}") for i in range(200)], "doc_id long, source string, text string")
    a = {r.text: r.mix_position for r in mixing.mix(df).collect()}
    b = {r.text: r.mix_position for r in mixing.mix(df.repartition(7)).collect()}
    assert a == b and len(set(itertools.chain(a.values()))) == 200


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def test_native_plan(spark, sf):
    plan = mixing.op4_pfair_mix(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert mixing.op4_pfair_mix(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert mixing.op4_pfair_mix(spark, sf).where(F.col("slot").isNull()).count() == 0
