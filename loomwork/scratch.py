"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing Parquet here and reading it
back.  The folder is the session's ``spark.checkpoint.dir``, or what
``setCheckpointDir`` named; where both are unset a temporary folder of the
driver serves a local session, and any other session is refused.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_made: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The URI under which driver and executors may exchange files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="loomwork-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


class Scratch:
    """Named tables of one run of one operator."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        _made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete one table, or everything; only tables no live plan reads."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    """A point in time for ``sweep``."""
    return len(_made)


def sweep(since: int) -> None:
    """Delete what operators have written since ``mark()``; call it once their results are written elsewhere."""
    while len(_made) > since:
        _made.pop().drop()


def settle(spark: SparkSession) -> None:
    """Have the driver collect its garbage: what finished jobs leave in it, and their shuffle files, goes only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
