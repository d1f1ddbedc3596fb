import itertools

import numpy as np
import xxhash

from loomwork.llm import simhash


def slow_fp(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    sh = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, tau=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= tau:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(spark, rows, schema="doc_id long, text string, fp string"):
    df = spark.createDataFrame(rows, schema)
    got = {r.id: (r.fp, r.component) for r in simhash.near_duplicates(df).collect()}
    ids = [r[0] for r in rows]
    fps = [slow_fp(r[1]) for r in rows]
    want = components(fps)
    for i, d in enumerate(ids):
        assert got[d][0] & (2**64 - 1) == fps[i]
        assert got[d][1] == min(ids[j] for j in range(len(ids)) if want[j] == want[i])


def test_edges_of_input(spark):
    rng = np.random.default_rng(1)
    vocab = ["Alpha", "béta", "gamma", "DELTA", "x", "ÉCOLE"]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(1, 30))), None) for i in range(120)]
    rows += [(200, None, None), (201, "", None), (202, " \n\t ", None), (203, "one two", None), (204, "ONE\x0btwo", None)]
    rows += [(205, "word " * 40000, None), (206, rows[0][1], "clash")]
    check(spark, rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_match_brute_force_in_dense_groups(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**63))
    fps = {int(rng.integers(0, 2**63)) for _ in range(300)}
    for _ in range(400):
        x = centre
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    from loomwork.scratch import Scratch

    s = Scratch(spark, "t")
    for chunk, parts in ((4096, None), (16, 4), (4096, 2), (16, 2)):
        links = simhash.linked(df, s, chunk=chunk, parts=parts)
        roots = {r.node: r.root for r in simhash.connected_components(links, s).collect()}
        want = components(fps)
        sig = [f - 2**64 if f >= 2**63 else f for f in fps]
        lab = [roots.get(f, f) for f in sig]
        for i, j in itertools.combinations(range(len(fps)), 2):
            assert (lab[i] == lab[j]) == (want[i] == want[j])


def test_partitions_widen_with_the_rows():
    at = lambda n: [simhash.expected_cost(n, p, 4) for p in (4, 2)]
    assert at(10**5)[0] < at(10**5)[1] and at(10**9)[0] > at(10**9)[1]
    # the cheaper one grows by far less than the rows do
    assert min(at(10**10)) < 60 * min(at(10**5))


def test_allocation_covers_and_sums():
    cost = np.random.default_rng(0).random((50, 4, 4)) * 100
    t = simhash.allocate(cost, 1)
    assert (t.sum(1) == 1).all()
    for r in range(50):
        best = min(sum(cost[r, k, c + 1] for k, c in enumerate(cs)) for cs in itertools.product(range(-1, 3), repeat=4) if sum(cs) == 1)
        assert abs(best - sum(cost[r, k, t[r, k] + 1] for k in range(4))) < 1e-9
