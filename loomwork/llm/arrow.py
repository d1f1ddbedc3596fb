"""Helpers for Arrow-batched Python stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


def bound_batches(spark: SparkSession, rows: int = 2000, mbytes: int = 16) -> None:
    """Bound an Arrow batch by rows and bytes, so that long texts don't add up.

    The settings are the session's; they change how rows travel, never results.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mbytes}m")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts in ``column`` hold about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def fresh_names(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened until none is that of a column (case does not count)."""
    used, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out
