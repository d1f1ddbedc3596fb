"""File sources and sinks: local text, structured exports, bundles, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONVERSATION = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))),
])


def text_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md}", most_bytes: int = 1 << 20) -> DataFrame:
    """(path, modified, size, text, ok): one row per file; ok is false for invalid UTF-8.

    Files over ``most_bytes`` are listed without text.  Order is by path only
    when the caller sorts.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= most_bytes
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(fits & good, F.col("content").cast("string"))
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), text.alias("text"), (fits & good).alias("ok"))


def export_conversations(conversations: DataFrame, path: str) -> None:
    """One JSON line per conversation with its messages in turn order.  A conversation must fit in memory."""
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    conversations.groupBy("conv_id").agg(messages.alias("messages")).write.mode("overwrite").json(path)


def import_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, turn, role, text) of a structured export; malformed lines are dropped with a null id."""
    raw = spark.read.schema(CONVERSATION).json(path)
    return raw.where("conv_id is not null").select("conv_id", F.explode("messages").alias("m")).select("conv_id", "m.*")


def export_bundle(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """A versioned evidence bundle: every row as JSON with its digest, partitioned by table."""
    parts = [t.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row")) for name, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("digest", F.sha2(F.col("row").cast("binary"), 256)).withColumn("version", F.lit(version))
    out.write.mode("overwrite").partitionBy("table").json(path)


def import_bundle(spark: SparkSession, path: str, table: str, schema: T.StructType, erased: DataFrame | None = None, key: str = "") -> DataFrame:
    """Rows of one table whose digest holds, minus those whose ``key`` is in ``erased``."""
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("row", "digest", "table")] + [T.StructField("version", T.LongType())])
    raw = spark.read.schema(kind).json(path).where((F.col("table") == table) & (F.sha2(F.col("row").cast("binary"), 256) == F.col("digest")))
    rows = raw.select(F.from_json("row", schema).alias("r")).select("r.*")
    return rows.join(erased.select(key).distinct(), key, "left_anti") if erased is not None else rows


def to_markdown(rows: DataFrame, group: str, key: str, text_col: str) -> DataFrame:
    """(group, markdown): a heading and one bullet per row with a provenance marker, by key."""
    line = F.struct(F.col(key).alias("k"), F.regexp_replace(text_col, r"\s*\n\s*", " ").alias("t"))
    items = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(F.lit("- "), x["t"], F.lit(" <!-- ref:"), x["k"].cast("string"), F.lit(" -->")))
    head = F.concat(F.lit("# "), F.col(group).cast("string"))
    return rows.groupBy(group).agg(items.alias("i")).select(group, F.concat(head, F.lit("\n\n"), F.array_join("i", "\n")).alias("markdown"))


def from_markdown(pages: DataFrame, group: str) -> DataFrame:
    """(group, key, text) of the marked bullets; unmarked lines are ignored."""
    lines = pages.select(group, F.explode(F.split("markdown", "\n")).alias("line"))
    pattern = r"^- (.*) <!-- ref:(-?\d+) -->$"
    hit = lines.where(F.col("line").rlike(pattern))
    return hit.select(group, F.regexp_extract("line", pattern, 2).cast("long").alias("key"), F.regexp_extract("line", pattern, 1).alias("text"))
