import itertools
import random

import numpy as np

import corpus_pipeline
from loomwork.llm import simhash_sets as shingles


def slow_set(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(texts, least=0.8):
    sets, root = [slow_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a and b and 10 * len(a & b) >= round(10 * least) * len(a | b)):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def near_texts(seed=7):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    out = []
    for i in range(25):
        words = [r.choice(vocab) for _ in range(r.randrange(60, 300))]
        out.append(" ".join(words))
        for edits in range(1, 9):  # similarity falls from near one to under 0.8
            copy = list(words)
            for at in r.sample(range(len(copy)), edits):
                copy[at] = r.choice(vocab)
            out.append(" ".join(copy))
    return out


def test_equals_brute_force(spark):
    texts = near_texts() + [None, "", " \n", "one two", "ONE\ttwo", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component for r in shingles.near_copies(df).collect()}
    assert got == dict(enumerate(components(texts)))


def test_members_that_miss_the_hub_are_linked(spark):
    # a chain: each text is like the next only, so most members are not like a bucket's smallest one
    words = [f"x{i}" for i in range(400)]
    texts = [" ".join(words[i * 15 : i * 15 + 200]) for i in range(13)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component for r in shingles.near_copies(df).collect()} == set(components(texts)) == {0}


def test_stage_drops_copies_of_similarity_080_to_095(spark):
    r = random.Random(9)
    words = [f"y{r.randrange(5000)}" for _ in range(200)]
    copy = list(words)
    for at in (20, 70, 130):  # 15 of 196 shingles differ: similarity 0.86
        copy[at] = "other"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(reversed(words))), (None, " ".join(words))], "doc_id long, text string")
    kept = sorted((x.doc_id or 0) for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [0, 1, 3]


def test_partitions_reach_the_similarity():
    for rows in (10**3, 10**6, 10**10):
        width, parts = shingles.layout(rows, 0.8, 1e-4)
        assert (1 - shingles.agreement(0.8) ** width) ** parts <= 1e-4
        assert 2 ** (width + 5) < rows * 4 or width == 8  # some tens of chance members a bucket


def test_fingerprint_bits_agree_as_often_as_the_angle_says():
    r = random.Random(1)
    same = total = 0
    for _ in range(40):
        a = [r.getrandbits(64) for _ in range(180)]
        b = a[:160] + [r.getrandbits(64) for _ in range(20)]  # 160 of 200: similarity 0.8
        x, y = (np.unpackbits(shingles.vote(np.unique(np.array(s, np.uint64)), 8)) for s in (a, b))
        same, total = same + (x == y).sum(), total + len(x)
    assert abs(same / total - shingles.agreement(0.8)) < 0.01


def test_large_groups_and_split_buckets(spark, monkeypatch):
    r = random.Random(5)
    words = [f"g{r.randrange(900)}" for _ in range(150)]
    texts = []
    for _ in range(400):  # near copies of one text, most of them linked to it
        copy = list(words)
        copy[r.randrange(150)] = "q" + str(r.randrange(10**6))
        texts.append(" ".join(copy))
    texts += near_texts(8)[:90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(components(texts)))
    assert {x.id: x.component for x in shingles.near_copies(df).collect()} == want
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert {x.id: x.component for x in shingles.near_copies(df).collect()} == want


def plan_of(values, width, parts, pair_cost):
    plan = shingles.Plan(np.arange(width * parts), width, pair_cost)
    cells, n = np.unique((np.arange(parts) << plan.bits) + values, return_counts=True)
    return plan.count(cells, n)


def test_thresholds_are_those_of_least_cost():
    r = np.random.default_rng(3)
    values = r.integers(0, 256, (600, 4))
    values[:500, 1] = 7  # a bucket that most rows share
    plan = plan_of(values, 8, 4, 0.05)
    got = plan.limits(values)
    assert (got.sum(1) == 0).all() and (got[:500, 1] == -1).all() and (got == 1).any()
    near = np.array([[[np.sum(np.bitwise_count(values[:, k] ^ v) <= t) for t in (0, 1)] for k, v in enumerate(row)] for row in values])
    assert np.allclose(plan.near(values), near)

    def cost(i, ts):
        return sum(0 if t < 0 else 0.05 * near[i, k, t] + 8 * t for k, t in enumerate(ts))

    for i in range(0, 600, 37):
        best = min(cost(i, ts) for ts in itertools.product((-1, 0, 1), repeat=4) if sum(ts) == 0)
        assert abs(cost(i, got[i]) - best) < 1e-6


def test_counts_of_wide_partitions():
    r = np.random.default_rng(4)
    sig = np.packbits(r.integers(0, 2, (3000, shingles.SKETCH + 14 * 3 + 6), np.uint8), axis=1)
    plan = shingles.Plan(r.permutation(42), 14)
    values = plan.values(shingles.pa.array([x.tobytes() for x in sig]))[0]
    assert plan.joined == 2 and plan.bits == 7 and values.max() < 1 << 14
    cells = np.arange(6).reshape(3, 2) * 128 + np.stack([values & 127, values >> 7], axis=2)
    near = plan.count(*np.unique(cells, return_counts=True)).near(values)
    assert near.shape == (3000, 3, 2) and 0.5 < near[:, :, 1].mean() / (3000 * 15 / 2**14) < 2


def test_fingerprints_within_the_partitions_meet():
    # bits that differ: fewer than partitions; a partition is left out (-1) wherever many share a value
    r = np.random.default_rng(5)
    width, parts = 8, 10
    bits = r.integers(0, 2, (1, shingles.SKETCH + width * parts), np.uint8).repeat(300, 0)
    for row in bits[1:]:
        at = shingles.SKETCH + r.choice(width * parts, r.integers(1, 14), replace=False)
        row[at] ^= 1
    sig = shingles.pa.array([x.tobytes() for x in np.packbits(bits, axis=1)])
    values = shingles.Plan(np.arange(width * parts), width).values(sig)[0]
    plan = plan_of(values, width, parts, 1.0)
    limits = plan.limits(values)
    assert (limits == -1).any() and (limits == 1).any()
    at, keys, role, _ = shingles._places(plan, sig, shingles.pa.array([x.tobytes() for x in limits.astype(np.int8)]))
    met = set()
    for key in np.unique(keys):
        own = keys == key
        i, j = np.nonzero(shingles._meet(role[own], role[own]))
        met |= set(zip(at[own][i].tolist(), at[own][j].tolist()))
    apart = (bits[:, None] != bits[None]).sum(2)
    want = [(i, j) for i, j in zip(*np.nonzero(apart < parts)) if i != j]
    assert len(want) > 100 and set(want) <= met


def test_unequal_thresholds_equal_brute_force(spark):
    r = random.Random(6)
    words = [f"h{r.randrange(900)}" for _ in range(120)]
    texts = near_texts(9)[:72]
    for _ in range(150):  # a large group, most pairs of which are below the similarity
        copy = list(words)
        for at in r.sample(range(120), r.randrange(1, 6)):
            copy[at] = "q" + str(r.randrange(10**6))
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.id: x.component for x in shingles.near_copies(df, pair_cost=1.0).collect()}
    assert got == dict(enumerate(components(texts)))


def test_second_round_sends_only_pairs_of_alike_fingerprints():
    # sets of similarity 0.6 to 0.7 are mostly close by the sketch, and far apart by the whole fingerprint
    r = random.Random(12)
    base = [r.getrandbits(64) for _ in range(160)]
    sets = [np.unique(np.array(base + [r.getrandbits(64) for _ in range(50)], np.uint64)) for _ in range(60)]
    sets += [np.unique(np.append(sets[0][:-8], np.uint64(k))) for k in range(3)]
    sig = np.array([shingles.vote(s, 12).tobytes() for s in sets], object)
    sketch = np.array([np.frombuffer(x, np.uint64)[:2] for x in sig])
    every = np.arange(len(sets))
    n = np.array([len(s) for s in sets])
    close = shingles._near(sketch, sketch).sum() - len(sets)
    got = [p for u, v in shingles._cross(sketch, every, every, np.ones(len(sets), np.int32), n, sig, every, every, 0.8) for p in zip(u.tolist(), v.tolist())]
    alike = {(i, j) for i in every for j in every if i < j and shingles.similar(sets[i], sets[j], 0.8)}
    assert alike and alike <= set(got) and len(got) < close / 3


def test_dense_buckets_name_leaders_in_some_partitions_only():
    sketch = np.zeros((30, 2), np.uint64)
    cid, both = np.arange(30), np.ones(30, np.int32)
    u, v, open_ = shingles.close_pairs(cid, sketch, both)
    assert (u == 0).all() and v.tolist() == list(range(1, 30)) and len(open_) == 30
    u, v, open_ = shingles.close_pairs(cid, sketch, both, False)
    assert not len(u) and not len(v) and len(open_) == 30
    assert len(shingles.close_pairs(cid[:3], sketch[:3], both[:3], False)[0]) == 3


def test_no_bucket_is_larger_than_its_bound():
    r = np.random.default_rng(8)
    values = r.integers(0, 256, (500, 4))
    values[:200, 2] = 9
    plan = plan_of(values, 8, 4, 1.0)
    limits = plan.limits(values)
    assert (limits == 1).any()
    i, k = np.nonzero(limits > 0)
    keys = np.append(((np.arange(4) << 8) + values).ravel(), (((k << 8) + values[i, k])[:, None] ^ plan.flips).ravel())
    keys, n = np.unique(keys, return_counts=True)
    assert (n <= plan.bound(keys)).all() and plan.bound(np.array([2 << 8 | 9]))[0] >= 200


def test_empty(spark):
    assert shingles.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_second_round_sends_texts_to_tiles_not_to_pairs(spark, monkeypatch):
    r, saved, save = random.Random(3), {}, shingles.Scratch.save

    def noted(self, df, name):
        saved[name] = save(self, df, name)
        return saved[name]

    monkeypatch.setattr(shingles.Scratch, "save", noted)
    monkeypatch.setattr(shingles, "BLOCK", 64)
    words = [f"w{r.randrange(900)}" for _ in range(200)]
    texts = []
    for i in range(200):  # two of them share 0.7 to 0.9 of their shingles
        copy = list(words)
        for at in r.sample(range(len(copy)), r.choice((2, 3))):
            copy[at] = f"x{i}y{at}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(shingles, "LEADING", 0)
    got = shingles.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.id: x.component for x in got} == dict(enumerate(components(texts)))
    assert saved["members"].count() < saved["left"].count() / 2
