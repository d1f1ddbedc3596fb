"""Exact nearest rows of many queries, by products of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL, SELF = -3.0, -np.inf  # below any cosine
HELD = 1 << 26  # bytes of best rows a task keeps between blocks


def _packs(most: int):
    """Blocks of at most ``most`` vectors, by id: (ids, vectors, dims), each a run of 8-byte numbers."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, most):
                part = b.slice(lo, most)
                ids, col = np.asarray(part.column(0)), part.column(1)
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0))
                dims = int(sizes.max())
                v = np.full((len(ids), dims), np.nan)
                flat = col.flatten()
                bad = np.repeat(np.arange(len(ids)), sizes)[np.asarray(flat.is_null())] if flat.null_count else []
                fits = sizes == dims
                values = np.asarray(pa.compute.fill_null(flat, 0.0)).astype(np.float64)
                v[fits] = values[np.repeat(fits, sizes)].reshape(-1, dims)
                null = (sizes == 0) | ~fits
                null[bad] = True
                for n in np.unique(sizes[~fits & (sizes > 0)]):  # another length is a block of its own
                    own = sizes == n
                    own[bad] = False
                    if own.any():
                        yield pack(ids[own], values[np.repeat(own, sizes)].reshape(-1, n), np.zeros(own.sum(), bool))
                null_only = null & ~(~fits & (sizes > 0) & ~np.isin(np.arange(len(ids)), bad))
                take = fits & ~null | null_only
                if take.any():
                    yield pack(ids[take], v[take], null[take])

    def pack(ids, v, null):
        order = np.argsort(ids, kind="stable")
        cols = [ids[order].astype(np.int64).tobytes(), v[order].tobytes(), null[order].tobytes()]
        return pa.RecordBatch.from_arrays([*(pa.array([c], pa.binary()) for c in cols), pa.array([v.shape[1]], pa.int32())], names=["ids", "vecs", "nulls", "dims"])

    return run


def _unpack(ids: bytes, vecs: bytes, nulls: bytes, dims: int):
    """(ids, unit vectors, null, nan): a zero vector, or one with a component that is not finite, has no direction."""
    ids, null = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool)
    v = np.frombuffer(vecs).reshape(len(ids), dims)
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.einsum("nd,nd->n", v, v))
        nan = ~null & ~(np.isfinite(norm) & (norm > 0))
        u = np.where((null | nan)[:, None], 0.0, v / norm[:, None])
    return ids, u, null, nan


def _keys(q, rows) -> np.ndarray:
    """Cosines; NULL where there is none, infinity where it is not a number, SELF for the query's own id."""
    (qid, uq, q_null, q_nan), (ids, u, null, nan) = q, rows
    if uq.shape[1] == u.shape[1]:
        s = uq @ u.T
        s[:, nan] = np.inf
        s[q_nan] = np.inf
    else:
        s = np.full((len(qid), len(ids)), NULL)
    s[:, null] = NULL
    s[q_null] = NULL
    lo, hi = np.searchsorted(ids, qid), np.searchsorted(ids, qid, "right")
    for i in np.flatnonzero(hi > lo):
        s[i, lo[i] : hi[i]] = SELF
    return s


def _rounded(key: np.ndarray, scale: float) -> np.ndarray:
    real = np.abs(key) < 2
    out = key.copy()
    out[real] = np.trunc(key[real] * scale + np.copysign(0.5, key[real])) / scale
    return out


def _best(s: np.ndarray, ids: np.ndarray, held, k: int, scale: float):
    """(query, id, rounded key) of the k best of a block and of those held, by query, key and id; ``ids`` ascend."""
    if held is not None:
        least = held[3] - 0.6 / scale  # what could round to the worst one held
    elif len(ids) > k:
        least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] - 1.1 / scale
    else:
        least = np.full(len(s), NULL - 1)
    near = s >= np.maximum(least, NULL - 1)[:, None]
    for i in np.flatnonzero(near.sum(1) > 16 * k):  # many equal ones: the smallest ids of them
        j = np.flatnonzero(near[i])
        near[i] = False
        near[i, j[np.argsort(-_rounded(s[i, j], scale), kind="stable")[:k]]] = True
    i, j = np.nonzero(near)
    parts = i, ids[j], _rounded(s[i, j], scale)
    if held is not None:
        parts = tuple(np.concatenate(x) for x in zip(held[:3], parts))
    i, n, key = parts
    order = np.lexsort((n, -key, i))
    i, n, key = i[order], n[order], key[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    own = place < k
    least = np.full(len(s), NULL - 1)
    full = place == k - 1
    least[i[full]] = key[full]
    return i[own], n[own], key[own], least


def cosine_nearest(rows: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(qid, unit_id, score) with the k best rows of every query among them, scores rounded.

    ``rows``: (id, vector), ``queries``: (qid, vector).  All rows are compared
    but those of the query's own id or of none.  A vector that is null, empty, of
    another length or holds a null has a null score, which comes last; a zero
    vector or one not finite has NaN, which comes first.  Blocks of rows meet
    blocks of queries; a task keeps each query's k best so far.
    """
    spark = rows.sparkSession
    scale = 10.0**digits
    rows, queries = (x.toDF("id", "v").where("id IS NOT NULL") for x in (rows, queries))
    shape = "ids binary, vecs binary, nulls binary, dims int"
    # vectors move once, so that few files are compared by all cores
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = rows.repartition(tasks, "id").mapInArrow(_packs(4096), shape)
    right = queries.mapInArrow(_packs(1024), shape).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "vecs", "nulls", "dims")])

    def run(batches):
        held, size, last, block = {}, 0, None, None
        for b in batches:
            for r in b.to_pylist() if b.num_rows < 64 else (x for lo in range(0, b.num_rows, 16) for x in b.slice(lo, 16).to_pylist()):
                if r["ids"] != last:
                    last, block = r["ids"], _unpack(r["ids"], r["vecs"], r["nulls"], r["dims"])
                name = (r["q_ids"], r["q_dims"], hash(r["q_vecs"]))
                q = _unpack(r["q_ids"], r["q_vecs"], r["q_nulls"], r["q_dims"])
                size += 0 if name in held else len(q[0]) * (k * 24 + 16)
                held[name] = _best(_keys(q, block), block[0], held.get(name), k, scale)
                if size > HELD:
                    yield from given(held)
                    held, size = {}, 0
        yield from given(held)

    def given(held):
        for (ids, _, _), (i, n, key, _) in held.items():
            score = pa.array(np.where(key == np.inf, np.nan, key), mask=key <= NULL, from_pandas=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)[i]), pa.array(n), score], names=["qid", "unit_id", "score"])

    return left.crossJoin(right).mapInArrow(run, "qid long, unit_id long, score double")
