"""Incremental statistics over a Structured Streaming file source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.scratch import Scratch


def grouped_counts(spark, folder: str, table: str, key: str, value: str) -> DataFrame:
    """(key, n, total) kept by a stream that appends one delta table per micro-batch.

    The sink writes each batch to a folder of its own number, so a replayed
    batch overwrites itself; the result is the sum of the deltas.
    """
    scratch = Scratch(spark, "stream")
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # a file stream reads a directory: the table's folder, or its parent with a name filter
    src = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 4)
    stream = src.parquet(f"{folder}/{table}.parquet*")

    def sink(batch: DataFrame, number: int) -> None:
        delta = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        delta.write.mode("overwrite").parquet(scratch.path(f"deltas/batch={number}"))

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    deltas = spark.read.parquet(scratch.path("deltas"))
    return deltas.groupBy(key).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


def session_counts(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Watermarked session windows of a stream, or of a batch."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, "w.start", "w.end", "n")


def backfill(spark, source: str, schema, out: str, checkpoint: str, files: int = 1) -> int:
    """Append what ``source`` holds beyond the checkpoint to ``out``; returns the rows appended.

    Runs in bounded steps of ``files`` files and ends when all are done; a run
    that was cut short goes on from its checkpoint, and files seen before are
    never read again.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p.numInputRows for p in q.recentProgress)
