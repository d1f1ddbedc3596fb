"""What the vector operators share: which rows take part, classes of equal vectors, second moments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, fine) & F.exists(vec, lambda x: x != 0), F.lit(False))


def prepare(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>, h1, h2) of usable vectors with an id.

    h1 and h2 are independent 64-bit hashes; equal vectors share both.
    """
    vec = F.col(vec_col).cast("array<double>")
    own = rows.select(F.col(id_col).alias("id"), vec.alias("vec")).where(usable(F.col("vec")) & F.col("id").isNotNull())
    # -0.0 equals 0.0 but hashes otherwise
    own = own.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    return own.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))


def by_length(vectors: DataFrame, vec_col: str = "vec") -> list[DataFrame]:
    """The rows of each vector length, shortest first; lengths are few, not data."""
    sizes = vectors.select(F.size(vec_col).alias("n")).distinct().collect()
    return [vectors.where(F.size(vec_col) == n) for n in sorted(r["n"] for r in sizes)]


def native(column: pa.Array) -> np.ndarray:
    """[rows, dims] of a list column without nulls, in its own precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def matrix(column: pa.Array) -> np.ndarray:
    """[rows, dims] of a list column without nulls, in double precision."""
    return native(column).astype(np.float64)


def second_moments(classes: DataFrame, dims: int, vec_col: str = "vec") -> np.ndarray:
    """Sum of outer products of the unit vectors; dims * (dims + 1) / 2 cells reach the driver."""

    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(0))
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                total += v.T @ v
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i * dims + j), pa.array(total[i, j])], names=["cell", "v"])

    rows = classes.select(vec_col).mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((dims, dims))
    for c, v in zip(rows["cell"], rows["v"]):
        out[c // dims, c % dims] = out[c % dims, c // dims] = v
    return out
