"""Registered source and sink round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.plans.registry import load, query
from loomwork.scratch import Scratch
from loomwork.sources import files


@query("conversation_export", "SELECT conv_id, turn, role, text FROM conversations")
def conversation_export(spark, d):
    path = Scratch(spark, "export").path("conversations")
    files.export_conversations(load(spark, d, "conversations"), path)
    return files.import_conversations(spark, path).select("conv_id", "turn", "role", "text")


@query("bundle_import", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def bundle_import(spark, d):
    """Export two tables, import one behind an erasure fence."""
    path = Scratch(spark, "bundle").path("bundle")
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    files.export_bundle({"customer": c, "nation": load(spark, d, "nation")}, path)
    erased = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return files.import_bundle(spark, path, "customer", c.schema, erased, "c_custkey")


@query("markdown_round_trip", r"SELECT conv_id, turn AS key, regexp_replace(text, '\s*\n\s*', ' ', 'g') AS text FROM conversations")
def markdown_round_trip(spark, d):
    pages = files.to_markdown(load(spark, d, "conversations"), "conv_id", "turn", "text")
    return files.from_markdown(pages, "conv_id")


@query("csv_round_trip", "SELECT p_partkey, p_name, p_size FROM part")
def csv_round_trip(spark, d):
    path = Scratch(spark, "csv").path("part")
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_size")
    p.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return spark.read.schema(p.schema).option("header", True).option("escape", '"').csv(path)


@query("orc_round_trip", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000")
def orc_round_trip(spark, d):
    path = Scratch(spark, "orc").path("orders")
    load(spark, d, "orders").select("o_orderkey", "o_totalprice").write.mode("overwrite").orc(path)
    return spark.read.orc(path).where("o_totalprice > 50000")
