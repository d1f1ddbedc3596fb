"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes.  cos >= t means a distance
of at most eps = sqrt(2 - 2t), so a pair's leading coordinates lie in equal or
adjacent cells of an eps grid.  The grid takes as many leading dimensions as
still part the vectors, more of them the more vectors there are.  Cells are cut
in tiles of bounded bytes, which are written to the scratch folder once; a pair of
tiles is a row that names where both lie, and its task reads them, so that vectors
are not copied for each pair.  Pairs of tiles whose leading coordinates lie further
apart than eps are never formed.  Within a pair, dot products grow by blocks of leading
dimensions, and a pair is dropped once the partial product plus the product of
the suffix norms (Cauchy-Schwarz) stays below t.  Survivors are decided in
double precision on the original vectors.  A pair sends on link counts and a
spanning forest, never its pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.graph import connected_components, spanning_forest
from loomwork.llm.vectors import by_length, matrix, native, prepare, second_moments, usable
from loomwork.scratch import Scratch

SLACK = 1e-9  # over rounding of rotated products


def axes(moments: np.ndarray) -> np.ndarray:
    """Orthonormal columns by falling second moment."""
    w, v = np.linalg.eigh(moments)
    return v[:, np.argsort(-w)]


def compare(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, least: float, same: bool, block: int = 16, step: int = 512):
    """Index pairs (i, j) with cosine >= least; i < j if ``same``.  Yields bounded parts."""
    ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    ra, rb = ua @ rotation, ub @ rotation
    dims = a.shape[1]
    cuts = [*range(block, dims, block), dims]
    tail = lambda r: [np.sqrt(np.maximum((r[:, c:] ** 2).sum(1), 0)) for c in cuts]
    ta, tb = tail(ra), tail(rb)
    for lo in range(0, len(a), step):
        hi = min(len(a), lo + step)
        part = ra[lo:hi, : cuts[0]] @ rb[:, : cuts[0]].T
        keep = part + ta[0][lo:hi, None] * tb[0][None, :] >= least - SLACK
        if same:
            keep &= np.arange(len(b))[None, :] > np.arange(lo, hi)[:, None]
        for first in range(0, hi - lo, 64):  # survivors of 64 rows at a time
            i, j = np.nonzero(keep[first : first + 64])
            i += first
            dot = part[i, j]
            for k in range(1, len(cuts)):
                if not len(i):
                    break
                dot = dot + np.einsum("nd,nd->n", ra[lo + i, cuts[k - 1] : cuts[k]], rb[j, cuts[k - 1] : cuts[k]])
                ok = dot + ta[k][lo + i] * tb[k][j] >= least - SLACK
                i, j, dot = i[ok], j[ok], dot[ok]
            if len(i):
                x, y = a[lo + i], b[j]
                cos = np.einsum("nd,nd->n", x, y) / (np.sqrt(np.einsum("nd,nd->n", x, x)) * np.sqrt(np.einsum("nd,nd->n", y, y)))
                ok = cos >= least
                if ok.any():
                    yield lo + i[ok], j[ok]


def leading_dims(moments: np.ndarray, n: int, eps: float, tile: int) -> int:
    """How many principal axes the grid uses.

    An axis of spread s parts vectors in about 2 s / eps cells, at least one;
    axes are added until the cells expected hold ``tile`` vectors each or
    another axis would part nothing.
    """
    spread = np.sqrt(np.maximum(np.sort(np.linalg.eigvalsh(moments))[::-1] / max(n, 1), 0))
    cells, used = 1.0, 0
    for s in spread[:8]:  # 3^8 adjacent cells at most
        if used and (cells * tile >= n or 4 * s <= eps):
            break
        cells *= max(1.0, 4 * s / eps)
        used += 1
    return max(1, used)


def links(classes: DataFrame, scratch: Scratch, least: float, tile: int | None = None, leading: int | None = None) -> DataFrame:
    """(u, v, edge): for edge false, class u has v linked other vectors; for
    edge true, u - v belongs to a forest that spans the links.

    ``classes``: (id, n, vec), vectors of one length and their copies; rows of
    one id are equal vectors and become one class.  ``tile`` bounds the vectors
    of a tile (4 MB of doubles if not given).
    """
    spark = classes.sparkSession
    top = classes.select(F.size("vec").alias("d")).first()
    if top is None:
        return spark.createDataFrame([], "u long, v long, edge boolean")
    dims = top["d"]
    tile = tile or max(256, (4 << 20) // (8 * dims))
    moments = second_moments(classes, dims)
    rotation = axes(moments)
    eps = math.sqrt(max(2 - 2 * least, 0)) + 1e-6
    leading = min(leading or leading_dims(moments, int(round(float(np.trace(moments)))), eps, tile), dims)
    span = math.floor(1 / eps) + 3  # cells on either side of zero, with a margin
    leading = max(1, min(leading, int(62 / math.log2(2 * span + 1))))  # a cell number fits in 62 bits
    base = 2 * span + 1
    shared = spark.sparkContext.broadcast(rotation)  # dims * dims

    def cells(v: np.ndarray) -> np.ndarray:
        lead = leading_coordinates(v, shared.value[:, :leading])
        cell = np.zeros(len(v), np.int64)
        for k in range(leading):
            cell = cell * base + np.floor(lead[:, k] / eps).astype(np.int64) + span
        return cell

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells(matrix(b.column(1))))], names=["id", "cell"])

    # classes of a cell, near enough, where they fill more than a tile: at most one entry a tile
    full = classes.select("id", "vec").mapInArrow(place, "id long, cell long").groupBy("cell").agg(F.approx_count_distinct("id").alias("c"))
    full = full.select("cell", F.ceil(F.col("c") / tile).alias("tiles")).where("tiles > 1").orderBy("cell").toPandas()
    split = spark.sparkContext.broadcast((full["cell"].to_numpy(np.int64), full["tiles"].to_numpy(np.int64)))
    kind = classes.schema["vec"].dataType.simpleString()
    part = "float32" if kind == "array<float>" else "float64"

    def deal(batches):
        known, tiles = split.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            first, total = merged(ids, n)  # copies of one batch travel once
            b = b.take(pa.array(first))
            cell = cells(matrix(b.column(2)))
            at = np.searchsorted(known, cell)
            at[at == len(known)] = 0
            count = np.where(known[at] == cell, tiles[at], 1) if len(known) else np.ones(len(cell), np.int64)
            t = (b.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % count.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), b.column(2), pa.array(cell), pa.array(t.astype(np.int32))], names=["id", "n", "vec", "cell", "t"])

    dealt = classes.select("id", "n", "vec").mapInArrow(deal, f"id long, n long, vec {kind}, cell long, t int")
    root = scratch.path("tilefiles")
    shape = "cell long, t int, file string, at long, m long, lo array<double>, hi array<double>"
    write = functools.partial(write_tiles, root=root, rotation=shared, leading=leading)
    boxes = scratch.save(dealt.repartition("cell", "t").sortWithinPartitions("cell", "t", "id").mapInArrow(write, shape), "boxes")

    offsets = [sum(d * base**k for k, d in enumerate(o)) for o in itertools.product((-1, 0, 1), repeat=leading)]
    side = lambda i: boxes.select(*[F.col(c).alias(f"{c}{i}") for c in boxes.columns])
    near = side(1).withColumn("o", F.explode(F.array(*[F.lit(o).cast("long") for o in offsets if o >= 0])))
    near = near.withColumn("cell2", F.col("cell1") + F.col("o")).join(side(2), "cell2")
    gap = lambda k: F.greatest(F.lit(0.0), F.col("lo1")[k] - F.col("hi2")[k], F.col("lo2")[k] - F.col("hi1")[k])
    apart = sum((gap(k) * gap(k) for k in range(leading)), F.lit(0.0))
    pairs = near.where((F.col("cell1") < F.col("cell2")) | (F.col("t1") <= F.col("t2"))).where(apart <= eps * eps)
    pairs = scratch.save(pairs.select("file1", "at1", "m1", "file2", "at2", "m2"), "pairs")

    def work(batches):
        last, held = None, None
        for b in batches:
            for r in b.to_pylist():
                one, other = (r["file1"], r["at1"]), (r["file2"], r["at2"])
                if one != last:
                    last, held = one, read_tile(root, *one, r["m1"], dims, part)
                yield linked(held, held if one == other else read_tile(root, *other, r["m2"], dims, part), shared.value, least, one == other)

    # tiles are read where they are compared: pairs move, vectors do not
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.repartition(tasks).sortWithinPartitions("file1", "at1")
    return scratch.save(dealt.mapInArrow(work, "u long, v long, edge boolean"), "links")


def leading_coordinates(v: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Rotated unit vectors, summed dimension by dimension: equal vectors get equal ones wherever they stand in a batch."""
    norm, lead = np.zeros(len(v)), np.zeros((len(v), rotation.shape[1]))
    for d in range(v.shape[1]):
        norm += v[:, d] * v[:, d]
        lead += v[:, d, None] * rotation[d]
    return lead / np.sqrt(norm)[:, None]


def merged(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and total n of the distinct ids."""
    _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, inverse, n)
    return first, total


def write_tiles(batches, root: str, rotation, leading: int):
    """Write each run of rows (id, n, vec) of one (cell, t) to this task's file; yields where it lies and its box."""
    fs, path = pafs.FileSystem.from_uri(root)
    file = f"{uuid.uuid4().hex}.bin"
    at, stream, key, held = 0, None, None, []

    def put():
        nonlocal at, stream
        if stream is None:
            fs.create_dir(path, recursive=True)
            stream = fs.open_output_stream(f"{path}/{file}")
        ids, n, v = (np.concatenate(x) for x in zip(*held))
        first, total = merged(ids, n)
        ids, v = ids[first], v[first]
        lead = leading_coordinates(v.astype(np.float64), rotation.value[:, :leading])
        raw = b"".join((ids.tobytes(), total.tobytes(), v.tobytes()))
        stream.write(raw)
        row = [[key[0]], [key[1]], [file], [at], [len(ids)], [lead.min(0).tolist()], [lead.max(0).tolist()]]
        at += len(raw)
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["cell", "t", "file", "at", "m", "lo", "hi"])

    try:
        for b in batches:
            if not b.num_rows:
                continue
            ids, n, cell, t = (b.column(c).to_numpy() for c in ("id", "n", "cell", "t"))
            v = native(b.column("vec"))
            cuts = (np.flatnonzero((cell[1:] != cell[:-1]) | (t[1:] != t[:-1])) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if held and key != (cell[lo], t[lo]):
                    yield put()
                    held = []
                key = (cell[lo], t[lo])
                first, total = merged(ids[lo:hi], n[lo:hi])  # a hot class is held once a batch
                held.append((ids[lo:hi][first], total, v[lo:hi][first]))
                if len(held) > 16:
                    whole = [np.concatenate(x) for x in zip(*held)]
                    first, total = merged(whole[0], whole[1])
                    held = [(whole[0][first], total, whole[2][first])]
        if held:
            yield put()
    finally:
        if stream is not None:
            stream.close()


def read_tile(root: str, file: str, at: int, m: int, dims: int, part: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, n, vectors in double precision) of a tile of components of type ``part``."""
    fs, path = pafs.FileSystem.from_uri(root)
    size = 16 * m + m * dims * np.dtype(part).itemsize
    with fs.open_input_file(f"{path}/{file}") as f:
        f.seek(at)
        raw = f.read(size)
    if len(raw) != size:
        raise ValueError(f"truncated tile in {file}")
    head = np.frombuffer(raw, np.int64, 2 * m)
    return head[:m], head[m:], np.frombuffer(raw, part, offset=16 * m).reshape(m, dims).astype(np.float64)


def linked(one, other, rotation: np.ndarray, least: float, same: bool) -> pa.RecordBatch:
    """Link counts and a spanning forest of two tiles, or of one with itself."""
    (ia, na, a), (ib, nb, b) = one, other
    got_a, got_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    eu, ev = [], []
    for i, j in compare(a, b, rotation, least, same):
        np.add.at(got_a, i, nb[j])
        np.add.at(got_b, j, na[i])
        f = spanning_forest(ia[i], ib[j])
        eu.append(f[0])
        ev.append(f[1])
    none = np.zeros(0, np.int64)
    fu, fv = spanning_forest(np.concatenate(eu), np.concatenate(ev)) if eu else (none, none)
    u = np.concatenate([ia[got_a > 0], ib[got_b > 0], fu])
    w = np.concatenate([got_a[got_a > 0], got_b[got_b > 0], fv])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64()), pa.array(np.arange(len(u)) >= len(u) - len(fu))], names=["u", "v", "edge"])


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """(id, n_links, component, kept) of every row; ``least`` in (0, 1].

    Equal vectors are compared once as a class and count as links of each
    other.  Vectors that are null, empty, zero or hold null or non-finite
    components have no links and are their own component; so do rows with a
    null id, whose component is null and which are kept.  Vectors of different
    length have no cosine: each length is compared within itself.  Repeated ids
    are separate vectors with one name.  An empty table gives an empty result;
    other columns are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    spark = rows.sparkSession
    scratch = Scratch(spark, "embdedup")
    own = prepare(rows, id_col, vec_col)
    if rows.schema[vec_col].dataType.simpleString() == "array<float>":  # floats travel as floats, which loses nothing
        own = own.withColumn("vec", F.col("vec").cast("array<float>"))
    # a class is a node by its hash, as ids may repeat; vectors are read again rather than copied
    nodes = own.select(F.xxhash64("h1", "h2").alias("id"), F.lit(1).cast("long").alias("n"), "vec")
    own = scratch.save(own.select("id", "h1", "h2"), "own")
    classes = scratch.save(own.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    parts = [links(part, Scratch(spark, "embdedup"), least) for part in by_length(nodes)]
    found = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "u long, v long, edge boolean")
    roots = connected_components(found.where("edge").select("u", "v"), scratch)
    counts = found.where("not edge").groupBy("u").agg(F.sum("v").alias("others"))
    named = classes.select("h1", "h2", F.xxhash64("h1", "h2").alias("c"), "id", "n")
    named = named.join(counts, F.col("c") == F.col("u"), "left").join(roots, F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c"))
    named = scratch.save(named.select("h1", "h2", "id", "root", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
    lows = named.groupBy("root").agg(F.min("id").alias("component"))
    named = named.join(lows, "root").select("h1", "h2", "n_links", "component")
    done = own.select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "n_links", "component")
    out = rows.where(~(usable(F.col(vec_col).cast("array<double>")) & F.col(id_col).isNotNull()))
    out = out.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component"))
    return done.unionByName(out).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), "kept")
