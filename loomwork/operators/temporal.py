"""As-of, range and near joins, sessions and versions over time-stamped rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, out: str) -> DataFrame:
    """``left`` plus the ``value`` of the latest right row at or before it.

    One union and one running window instead of a non-equi join: a key's rows
    are read once, in time order.  At equal times the right row comes first.
    """
    cols = left.columns
    side = left.select(*cols, F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"))
    other = right.select(*[F.col(c) if c in (key, ts) else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in cols], F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = W.partitionBy(key).orderBy(ts, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = side.unionByName(other).withColumn(out, F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*cols, out)


def within(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Pairs of equal key whose times differ by at most ``seconds``: equi-join on time buckets.

    Columns are prefixed l_ and r_; a left row meets its own bucket and both
    neighbours.
    """
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp_ltz")) / seconds)
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], bucket.alias("__b"))
    gap = F.abs(micros(F.col(f"l_{ts}")) - micros(F.col(f"r_{ts}")))
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (a["__b"] == b["__b"])).drop("__b").withColumn("gap_us", gap).where(F.col("gap_us") <= seconds * 1_000_000)


def micros(ts):
    return F.unix_micros(ts.cast("timestamp_ltz"))


def sessions(rows: DataFrame, key: str, ts: str, gap_seconds: int = 1800, tie: str | None = None) -> DataFrame:
    """``rows`` with session_no: a new one after a gap of more than ``gap_seconds``."""
    w = W.partitionBy(key).orderBy(ts, *([tie] if tie else []))
    late = micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w) > gap_seconds * 1_000_000
    return rows.withColumn("__new", F.coalesce(late, F.lit(False)).cast("int")).withColumn("session_no", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1).drop("__new")


def latest(rows: DataFrame, keys: list[str], ts: str, tie: str, columns: list[str]) -> DataFrame:
    """The newest row of each key; max_by pre-aggregates, so a hot key is no bottleneck."""
    best = F.max_by(F.struct(*columns), F.struct(ts, tie))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}") for c in columns])
