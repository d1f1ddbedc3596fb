"""Entity aliases and the linking of query texts to known names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text


def link(queries: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """(qid, start, canon): greedy longest matches of up to ``longest`` words.

    ``queries(qid, query)``, ``names(canon)``.  Among the known n-grams of a
    query the leftmost is taken, the longest of those that start together, and
    the search goes on behind it.
    """
    words = queries.select("qid", text.tokens(F.col("query")).alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("w") >= n, F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(i.alias("start"), n.alias("n"), F.array_join(F.slice("w", i, n), " ").alias("canon"))
    )).otherwise(F.array().cast("array<struct<start:int,n:int,canon:string>>"))))
    grams = words.select("qid", F.explode(spans).alias("s")).select("qid", "s.*")
    hits = grams.join(names.select("canon").distinct(), "canon", "left_semi")
    ordered = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("n")).alias("m"), "canon"))).alias("h"))  # a query's length bounds it
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,m:int,canon:string>>").alias("out"))
    take = F.aggregate("h", none, lambda a, h: F.when(h["start"] >= a["at"], F.struct((h["start"] - h["m"]).alias("at"), F.concat(a["out"], F.array(h)).alias("out"))).otherwise(a))
    return ordered.select("qid", F.explode(take["out"]).alias("t")).select("qid", "t.start", "t.canon")


def subset_aliases(names: DataFrame) -> DataFrame:
    """(alias, canon, candidates, status): names whose words are a proper subset of another's.

    Active if exactly one longer name holds them, else all are candidates.
    Pairs meet on the alias's rarest word, so that a common word draws no crowd.
    """
    n = names.select("canon").distinct().withColumn("w", F.array_distinct(F.split("canon", " ")))
    each = n.select("canon", F.size("w").alias("size"), F.explode("w").alias("word"))
    df = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    r = F.row_number().over(W.partitionBy("canon").orderBy("df", "word"))
    rare = each.join(df, "word").withColumn("r", r).where("r = 1").select(F.col("canon").alias("alias"), "word")
    pairs = rare.join(each.where("size > 1").select("word", "canon"), "word").where("alias <> canon")
    pairs = pairs.withColumn("a", F.array_distinct(F.split("alias", " "))).withColumn("c", F.array_distinct(F.split("canon", " ")))
    pairs = pairs.where((F.size(F.array_except("a", "c")) == 0) & (F.size("a") < F.size("c"))).select("alias", "canon")
    many = pairs.groupBy("alias").agg(F.count(F.lit(1)).alias("candidates"))
    return pairs.join(many, "alias").withColumn("status", F.when(F.col("candidates") == 1, "active").otherwise("candidate"))


def initial_aliases(names: DataFrame) -> DataFrame:
    """(alias, canon): two-word names and their "first l" form, where it is a known name too."""
    n = names.select("canon").distinct()
    two = n.where(F.size(F.split("canon", " ")) == 2)
    short = F.concat(F.split_part("canon", F.lit(" "), F.lit(1)), F.lit(" "), F.substring(F.split_part("canon", F.lit(" "), F.lit(2)), 1, 1))
    return two.withColumn("alias", short).where("alias <> canon").join(n.select(F.col("canon").alias("alias")), "alias", "left_semi").select("alias", "canon")
