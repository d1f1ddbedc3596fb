"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors form one node.  The graph starts poor: random trees cut all nodes
in leaves of ``leaf`` at most, whatever their number, and a node knows its
nearest within its leaves.  Rounds then join every node's neighbours and
nearest reverse neighbours with one another, compare those pairs of which one is
new, and keep the ``k`` nearest of each node, until few lists change.  A query
keeps a beam of its nearest nodes and expands, by joins, the unexpanded ones
until none is left.  Results are scored exactly in double precision on the
original vectors.

Nodes live in home blocks of bounded size (codes of random hyperplanes, split by
hash where a code has more rows).  A round ships each vector once to every block
that needs it, however many of the block's nodes do, and a block sends on at
most ``best`` candidates of a node.
"""

from __future__ import annotations

import functools
import itertools
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.llm.vectors import by_length, matrix, native, prepare
from loomwork.scratch import Scratch

SALTS = 16
ROW = "h long, data binary"
GRAPH = "h long, data binary, changed long"


def nearest(group: np.ndarray, d: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` rows of smallest (d, tie) of each group."""
    order = np.lexsort((tie, d, group))
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < most]


def unique_pairs(u: np.ndarray, v: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Positions of one row of each (u, v), that with the smallest ``worse``."""
    order = np.lexsort((worse, v, u))
    a, b = u[order], v[order]
    return order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))] if len(a) else order


def packed(dest: np.ndarray, arrays: list[np.ndarray]) -> pa.Table:
    """One row (h, data) for each destination block, data holding its rows of the arrays."""
    order = np.argsort(dest, kind="stable")
    h = dest[order]
    cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(h))
    data = [pickle.dumps([a[order[lo:hi]] for a in arrays], 5) for lo, hi in zip(cuts, ends)]
    return pa.table({"h": pa.array(h[cuts], pa.int64()), "data": pa.array(data, pa.binary())})


def unpacked(data, kinds: tuple) -> list[np.ndarray]:
    """The arrays of all ``data`` values, joined."""
    parts = [pickle.loads(x) for x in data]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(kinds)]


def _data(table: pa.Table) -> list[bytes]:
    return table.column("data").to_pylist() if table.num_rows else []


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _vectors(table: pa.Table, mean: np.ndarray) -> np.ndarray:
    """Centred rows in double precision."""
    parts = [native(c) for c in table.column("vec").chunks if len(c)]
    return np.concatenate(parts).astype(np.float64) - mean if parts else np.zeros((0, len(mean)))


def leaves(x: np.ndarray, leaf: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A random tree: rows halved at the median of random directions until ``leaf`` or fewer are left."""
    todo, out = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        order = own[np.argsort(x[own] @ rng.normal(size=x.shape[1]), kind="stable")]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


def place(nodes: DataFrame, scratch: Scratch, n: int, mean: np.ndarray, trees: int, block: int, seed: int) -> DataFrame:
    """(tree, part, home, id, vec): each node once a tree; a part has about ``block`` rows at most twice over."""
    depth = max(0, math.ceil(math.log2(max(n / block, 1))))
    shared = nodes.sparkSession.sparkContext.broadcast((np.random.default_rng(seed).normal(size=(trees, len(mean), depth)), mean))  # trees * dims * log2(n)

    def code(batches):
        planes, mean = shared.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1)) - mean
                codes = np.stack([(x @ p > 0) @ (1 << np.arange(p.shape[1])) if p.shape[1] else np.zeros(len(x), np.int64) for p in planes], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(planes)), pa.array(codes.ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["id", "vec", "codes"])

    kind = nodes.schema["vec"].dataType.simpleString()
    coded = scratch.save(nodes.select("id", "vec").mapInArrow(code, f"id long, vec {kind}, codes array<long>"), "coded")
    flat = coded.select("id", "vec", F.col("codes")[0].alias("first"), F.posexplode("codes").alias("tree", "code"))
    sizes = flat.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("c"))
    part = lambda c, tree: F.shiftleft(F.col("code"), 20) + F.pmod(F.xxhash64("id", tree), F.ceil(F.col(c) / (2 * block)))
    homes = sizes.where("tree = 0").select(F.col("code").alias("first"), F.col("c").alias("first_c"))
    out = flat.join(sizes, ["tree", "code"]).join(homes, "first").withColumn("part", part("c", F.col("tree")))
    home = F.shiftleft(F.col("first"), 20) + F.pmod(F.xxhash64("id", F.lit(0)), F.ceil(F.col("first_c") / (2 * block)))
    return scratch.save(out.select("tree", "part", home.alias("home"), "id", "vec"), "placed")


def seeds(placed: DataFrame, mean: np.ndarray, k: int, leaf: int, seed: int) -> DataFrame:
    """(h, data): edges to the nearest nodes within the leaves of every tree, by home block."""
    shared = placed.sparkSession.sparkContext.broadcast(mean)

    def run(table: pa.Table) -> pa.Table:
        ids, home, x = _column(table, "id"), _column(table, "home"), _vectors(table, shared.value)
        order = np.argsort(ids)  # rows come in any order; results don't depend on it
        ids, home, x = ids[order], home[order], x[order]
        rng = np.random.default_rng([seed, int(table.column("tree")[0].as_py()), int(table.column("part")[0].as_py())])
        us, vs, ds = [], [], []
        for own in leaves(x, leaf, rng):
            m = min(k, len(own) - 1)
            if m < 1:
                continue
            sq = (x[own] ** 2).sum(1)
            d = np.maximum(sq[:, None] + sq[None, :] - 2 * x[own] @ x[own].T, 0)
            np.fill_diagonal(d, np.inf)
            at = np.argpartition(d, m - 1, axis=1)[:, :m]
            us.append(np.repeat(own, m))
            vs.append(own[at].ravel())
            ds.append(np.sqrt(np.take_along_axis(d, at, 1)).ravel())
        u, v, d = (np.concatenate(c) if c else np.zeros(0, t) for c, t in ((us, np.int64), (vs, np.int64), (ds, np.float64)))
        return packed(home[u], [ids[u], home[v], ids[v], d])

    return placed.groupBy("tree", "part").applyInArrow(run, ROW)


def _keep(h: int, old: list[np.ndarray], new: list[np.ndarray], k: int) -> pa.Table:
    """Of old and new edges of block h, each node's k nearest; an old edge found again stays old."""
    fresh = np.append(np.zeros(len(old[0]), bool), np.ones(len(new[0]), bool))
    u, hv, v, d = (np.concatenate([a, b]) for a, b in zip(old, new))
    at = unique_pairs(u, v, fresh)
    at = at[nearest(u[at], d[at], v[at], k)]
    data = pickle.dumps([u[at], hv[at], v[at], d[at], fresh[at]], 5)
    return pa.table({"h": pa.array([h], pa.int64()), "data": pa.array([data], pa.binary()), "changed": pa.array([int(fresh[at].sum())], pa.int64())})


def _block(*tables: pa.Table) -> int:
    return next(t.column("h")[0].as_py() for t in tables if t.num_rows)


def reverse_edges(graph: DataFrame, reverse: int) -> DataFrame:
    """(h, data): edges seen from their end, for the end's block.

    A task sends on the ``reverse`` nearest of each node from every million
    edges, so that a hub's in-edges never meet in full.
    """

    def run(batches):
        held, rows = [], 0
        for b in batches:
            for x in b.column("data").to_pylist():
                held.append((b.column("h")[0].as_py(), pickle.loads(x)))
                rows += len(held[-1][1][0])
                if rows >= 1 << 20:
                    yield from cut(held)
                    held, rows = [], 0
        yield from cut(held)

    def cut(held):
        if held:
            u, hv, v, d, fresh = (np.concatenate([p[k] for _, p in held]) for k in range(5))
            hu = np.repeat(np.array([h for h, _ in held]), [len(p[0]) for _, p in held])
            at = nearest(v, d, u, reverse)
            yield from packed(hv[at], [v[at], u[at], hu[at], d[at], fresh[at]]).to_batches()

    return graph.select("h", "data").repartition("h").mapInArrow(_one_row(run), ROW)


def _one_row(run):
    """``run`` over batches of one row each: a row holds a whole block."""
    return lambda batches: run(b.slice(i, 1) for b in batches for i in range(b.num_rows))


def members(graph: DataFrame, reverse: int) -> DataFrame:
    """What block h compares, and what it needs for that.

    Rows with a null ``of`` hold (w, m, fresh): centre w's neighbours and nearest
    reverse neighbours.  The others name the members that live in block ``of``.
    """

    def run(ahead: pa.Table, behind: pa.Table) -> pa.Table:
        h = _block(ahead, behind)
        u, hv, v, _, fresh = unpacked(_data(ahead), (np.int64, np.int64, np.int64, float, bool))
        w, m, hm, d, new = unpacked(_data(behind), (np.int64, np.int64, np.int64, float, bool))
        at = nearest(w, d, m, reverse)
        w, m, hm, fresh = np.append(u, w[at]), np.append(v, m[at]), np.append(hv, hm[at]), np.append(fresh, new[at])
        at = unique_pairs(w, m, ~fresh)
        at = at[np.isin(w[at], np.unique(w[at][fresh[at]]))]  # a centre none of whose members is new has nothing to compare
        w, m, hm, fresh = w[at], m[at], hm[at], fresh[at]
        ids, one = np.unique(m, return_index=True)
        wanted = packed(hm[one], [ids])
        own = pa.table({"h": pa.array([h], pa.int64()), "of": pa.array([None], pa.int64()), "data": pa.array([pickle.dumps([w, m, fresh], 5)], pa.binary())})
        return pa.concat_tables([own, pa.table({"h": pa.array([h] * wanted.num_rows, pa.int64()), "of": wanted.column("h"), "data": wanted.column("data")})])

    back = reverse_edges(graph, reverse)
    return graph.groupBy("h").cogroup(renewed(back).groupBy("h")).applyInArrow(run, "h long, of long, data binary")


def vectors_for(wanted: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """(h, data): the vectors, homes and k-th distances that block h asked for."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return packed(np.zeros(0, np.int64), [])
        home = asked.column("of")[0].as_py()
        ids, raw = pickle.loads(held.column("vectors")[0].as_py())
        u, _, _, d, _ = unpacked(_data(held), (np.int64, np.int64, np.int64, float, bool))
        kth = np.full(len(ids), np.inf)
        at = np.searchsorted(ids, u)
        count, far = np.bincount(at, minlength=len(ids)), np.zeros(len(ids))
        np.maximum.at(far, at, d)
        kth[count >= k] = far[count >= k]
        out = []
        for x in _data(asked):
            at = np.searchsorted(ids, pickle.loads(x)[0])
            out.append(pickle.dumps([ids[at], np.full(len(at), home), kth[at], raw[at]], 5))
        return pa.table({"h": asked.column("h"), "data": pa.array(out, pa.binary())})

    return wanted.groupBy("of").cogroup(renewed(state).groupBy("h")).applyInArrow(run, ROW)


def renewed(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so that both sides of a cogroup differ."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def local_join(pairs: DataFrame, needed: DataFrame, mean: np.ndarray, best: int, near: int) -> DataFrame:
    """(h, data): candidate edges from pairs of members that share a centre, one of them new.

    A candidate must beat its node's present k-th distance.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(mean)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return packed(np.zeros(0, np.int64), [])
        w, m, fresh = unpacked(_data(left), (np.int64, np.int64, bool))
        ids, home, kth, raw = unpacked(_data(right), (np.int64, np.int64, float, float))
        order = np.argsort(ids)
        ids, home, kth, raw = ids[order], home[order], kth[order], raw[order]
        m = np.searchsorted(ids, m)  # rows come sorted by centre
        start = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(w)))
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lo in range(0, len(start), 64):
            s, n = start[lo : lo + 64], size[lo : lo + 64]
            at = np.minimum(s[:, None] + np.arange(n.max()), len(w) - 1)
            ok = np.arange(n.max()) < n[:, None]
            who = m[at]
            x = raw[who].astype(np.float64) - shared.value
            sq = (x**2).sum(2)
            d = sq[:, :, None] + sq[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
            limit = np.square(kth[who])[:, :, None]
            use = ok[:, :, None] & ok[:, None, :] & (fresh[at][:, :, None] | fresh[at][:, None, :]) & (who[:, :, None] != who[:, None, :]) & (d < limit)
            d[~use] = np.inf
            if d.shape[2] > near:  # of a member's pairs at a centre, the nearest few
                use &= d <= np.partition(d, near - 1, axis=2)[:, :, near - 1 : near]
            g, i, j = np.nonzero(use)
            held.append((who[g, i], who[g, j], d[g, i, j]))
            if sum(len(c[0]) for c in held) > 1 << 20:
                held = [few(held)]
        u, v, d = few(held)
        # exact differences: no loss by cancellation within tight clusters
        for lo in range(0, len(u), 1 << 16):
            p, q = u[lo : lo + (1 << 16)], v[lo : lo + (1 << 16)]
            d[lo : lo + (1 << 16)] = np.sqrt(((raw[p].astype(np.float64) - raw[q].astype(np.float64)) ** 2).sum(1))
        return packed(home[u], [ids[u], home[v], ids[v], d])

    def few(held):
        u, v, d = (np.concatenate(c) for c in zip(*held))
        at = unique_pairs(u, v, d)
        at = at[nearest(u[at], d[at], v[at], best)]
        return u[at], v[at], d[at]

    return pairs.groupBy("h").cogroup(renewed(needed).groupBy("h")).applyInArrow(run, ROW)


def build(nodes: DataFrame, scratch: Scratch, k: int = 32, reverse: int = 24, trees: int = 4, leaf: int = 128, best: int = 16, near: int = 8, block: int = 2048, rounds: int = 30, settle: float = 0.04, seed: int = 11) -> DataFrame:
    """(u, next): the neighbour graph of ``nodes(id, vec)``, all of one length.

    Rounds go on until no more than ``settle`` of all edges change; ``rounds`` is
    a guard that raises unless it is given as less than 30 on purpose.  One tree's
    leaves share no edge, so that rounds need two or more.
    """
    if trees < 2:
        raise ValueError("the descent starts from two trees or more")
    spark = nodes.sparkSession
    n = nodes.count()
    top = nodes.select(F.size("vec").alias("d")).first()
    if top is None:
        return spark.createDataFrame([], "u long, next array<long>")
    dims = top["d"]
    means = nodes.agg(*[F.avg(F.element_at("vec", i + 1)).alias(f"m{i}") for i in range(dims)]).first()
    mean = np.array(means, np.float64)
    # a block's vectors stay within some tens of MB whatever their length
    placed = place(nodes, scratch, n, mean, trees, max(256, block * 64 // max(dims, 64)), seed)
    own = placed.where("tree = 0").groupBy("home").applyInArrow(_hold, "h long, vectors binary")
    own = scratch.save(own, "blocks")

    def merge(old: pa.Table, more: pa.Table) -> pa.Table:
        kinds = (np.int64, np.int64, np.int64, float)
        return _keep(_block(old, more), unpacked(_data(old), kinds), unpacked(_data(more), kinds), k)

    first = seeds(placed, mean, k, leaf, seed)
    empty = own.select("h", F.lit(None).cast("binary").alias("data")).where("false")
    graph = scratch.save(empty.groupBy("h").cogroup(renewed(first).groupBy("h")).applyInArrow(merge, GRAPH), "g0")
    for r in range(1, rounds + 1):
        joined = scratch.save(members(graph, reverse), f"m{r}")
        wanted = joined.where("of is not null")
        needed = vectors_for(wanted, own.join(graph.select("h", "data"), "h"), k)
        found = local_join(joined.where("of is null").select("h", "data"), needed, mean, best, near)
        new = scratch.save(graph.groupBy("h").cogroup(renewed(found).groupBy("h")).applyInArrow(merge, GRAPH), f"g{r}")
        changed = new.agg(F.sum("changed").alias("c")).first()["c"] or 0
        scratch.drop(f"g{r - 1}")
        scratch.drop(f"m{r}")
        graph = new
        if changed <= settle * n * k:
            break
    else:
        if rounds >= 30:
            raise RuntimeError(f"the graph did not settle in {rounds} rounds")
    return links(graph)


def _hold(table: pa.Table) -> pa.Table:
    """One row for a block: its ids in order, and their vectors."""
    ids = _column(table, "id")
    order = np.argsort(ids)
    raw = np.concatenate([native(c) for c in table.column("vec").chunks if len(c)])
    return pa.table({"h": pa.array([table.column("home")[0].as_py()], pa.int64()), "vectors": pa.array([pickle.dumps([ids[order], raw[order]], 5)], pa.binary())})


def links(graph: DataFrame) -> DataFrame:
    """(u, next array<long>) of a graph in blocks: each node's neighbours, nearest first."""

    def run(batches):
        for b in batches:
            for x in b.column("data").to_pylist():
                u, _, v, d, _ = pickle.loads(x)
                order = np.lexsort((v, d, u))
                u, v = u[order], v[order]
                ends = np.append(np.flatnonzero(u[1:] != u[:-1]) + 1, len(u)) if len(u) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(v))
                yield pa.RecordBatch.from_arrays([pa.array(u[ends - 1]), lists], names=["u", "next"])

    return graph.select("data").mapInArrow(run, "u long, next array<long>")


STATE = "q long, data binary, open array<long>"


def _state(q: int, y: np.ndarray, v: np.ndarray, d: np.ndarray, done: np.ndarray, wide: int) -> dict:
    return {"q": q, "data": pickle.dumps([y, v, d, done], 5), "open": v[~done][:wide].tolist()}


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, scratch: Scratch, beam: int = 192, landmarks: int = 64, entries: int = 4, wide: int = 48) -> DataFrame:
    """(q, v, d): each query's beam of nearest nodes found by greedy search.

    A step expands the ``wide`` nearest unexpanded nodes of every beam; the
    search ends when no beam has any.  It does end: no node is expanded twice
    while in a beam, and one that left it never comes back.

    ``queries``: (q, vec, node), q without repeats; node is the graph node with
    the query's own vector, or null for a query from outside.  ``graph``: (u, next).
    """
    spark = nodes.sparkSession
    marks = nodes.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(landmarks).select("id", "vec").toPandas()  # bounded
    if not len(marks):
        return spark.createDataFrame([], "q long, v long, d double")
    shared = spark.sparkContext.broadcast((marks["id"].to_numpy(np.int64), np.stack(marks["vec"]).astype(np.float64)))
    schema = pa.schema([("q", pa.int64()), ("data", pa.binary()), ("open", pa.list_(pa.int64()))])

    def enter(batches):
        ids, v = shared.value
        for b in batches:
            rows = []
            for q, y, node in zip(b.column(0).to_pylist(), matrix(b.column(1)) if b.num_rows else [], b.column(2).to_pylist()):
                d = np.sqrt(((v - y) ** 2).sum(1))
                at = np.argsort(d, kind="stable")[:entries]
                own, far = (ids[at], d[at]) if node is None else (np.append(node, ids[at]), np.append(0.0, d[at]))
                own, one = np.unique(own, return_index=True)
                order = np.lexsort((own, far[one]))
                rows.append(_state(q, y, own[order], far[one][order], np.zeros(len(own), bool), wide))
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    def step(state: pa.Table, hits: pa.Table) -> pa.Table:
        q, data, open_ = (state.column(c)[0].as_py() for c in ("q", "data", "open"))
        if not open_:
            return state
        y, v, d, done = pickle.loads(data)
        done = done | np.isin(v, np.array(open_))
        if hits.num_rows:
            ids = _column(hits, "v")
            x = np.concatenate([native(c) for c in hits.column("vec").chunks if len(c)]).astype(np.float64)
            fresh = ~np.isin(ids, v)
            ids, far = ids[fresh], np.sqrt(((x[fresh] - y) ** 2).sum(1))
            v, d, done = np.append(v, ids), np.append(d, far), np.append(done, np.zeros(len(ids), bool))
            order = np.lexsort((v, d))[:beam]
            v, d, done = v[order], d[order], done[order]
        return pa.Table.from_pylist([_state(q, y, v, d, done, wide)], schema=schema)

    state = scratch.save(queries.select("q", "vec", "node").mapInArrow(enter, STATE), "s0")
    for r in itertools.count(1):
        if not state.where(F.size("open") > 0).limit(1).count():
            break
        open_ = state.select("q", F.explode("open").alias("u"))
        ahead = open_.join(graph, "u").select("q", F.explode("next").alias("v")).distinct()
        hits = ahead.join(nodes.select(F.col("id").alias("v"), "vec"), "v").select("q", "v", "vec")
        state = scratch.save(state.groupBy("q").cogroup(renewed(hits).groupBy("q")).applyInArrow(step, STATE), f"s{r}")
        scratch.drop(f"s{r - 1}")

    def rows(batches):
        for b in batches:
            for q, x in zip(b.column("q").to_pylist(), b.column("data").to_pylist()):
                _, v, d, _ = pickle.loads(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), q)), pa.array(v), pa.array(d)], names=["q", "v", "d"])

    return state.select("q", "data").mapInArrow(rows, "q long, v long, d double")


def neighbours(rows: DataFrame, every: int, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 10, beam: int = 192, **graph_options) -> DataFrame:
    """(query_id, rank, id, score): the ``top`` nearest rows found for the rows whose id is divisible by ``every``.

    A query is no candidate of itself; ties go to the smaller id; with fewer
    candidates all are returned.  Vectors that are null, empty, zero, or with
    null or non-finite components, and rows with a null id, are neither queries
    nor candidates.  Vectors of different length have no distance: each length
    has its own graph, one after the other.  Of repeated ids, each vector is a
    candidate and the first by hash a query.  An empty table gives an empty
    result; other columns are ignored.
    """
    scratch = Scratch(rows.sparkSession, "nndescent")
    own = scratch.save(prepare(rows, id_col, vec_col), "own")
    one = F.row_number().over(W.partitionBy("id").orderBy("h1", "h2"))
    first = own.where(F.col("id") % every == 0).withColumn("r", one).where("r = 1").select("id", "h1", "h2")
    single = rows.schema[vec_col].dataType.simpleString() == "array<float>"
    parts = [_within(part, first, Scratch(rows.sparkSession, "nndescent"), top, beam, single, graph_options) for part in by_length(own)]
    kind = f"query_id {own.schema['id'].dataType.simpleString()}, rank int, id {own.schema['id'].dataType.simpleString()}, score double"
    return functools.reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], kind)


def _within(own: DataFrame, first: DataFrame, scratch: Scratch, top: int, beam: int, single: bool, graph_options: dict) -> DataFrame:
    """``neighbours`` among usable vectors of one length."""
    classes = own.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("vec").alias("vec"))
    if single:  # components that come as floats travel as floats, which loses nothing
        classes = classes.withColumn("vec", F.col("vec").cast("array<float>"))
    classes = scratch.save(classes, "classes")
    # node ids are the smallest id of a class and may repeat only if ids do
    spread = F.xxhash64("h1", "h2")
    nodes = classes.select(spread.alias("id"), "vec")
    graph = scratch.save(build(nodes, scratch, **graph_options), "graph")
    asked = own.join(first, ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"])
    queries = asked.select(F.col("id").alias("q"), "vec", spread.alias("node"))
    found = search(queries, nodes, graph, scratch, beam)
    # members: a query needs the top + 1 smallest ids of a class at most
    salted = own.select("id", "h1", "h2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    few = salted.withColumn("r", F.row_number().over(W.partitionBy("h1", "h2", "salt").orderBy("id"))).where(F.col("r") <= top + 1)
    few = few.withColumn("r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= top + 1)
    out = found.join(few.select(spread.alias("v"), F.col("id").alias("member")), "v").where("member != q")
    rank = F.row_number().over(W.partitionBy("q").orderBy("d", "member"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("q").alias("query_id"), "rank", F.col("member").alias("id"), F.col("d").alias("score"))


def op9_nn_descent(spark, sf_dir: str) -> DataFrame:
    out = neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100)
    return out.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
