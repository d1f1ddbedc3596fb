"""A stored inverted index: postings by term bucket, statistics by generation.

A generation appends the postings of its own units, partitioned by a hash of the
term and sorted by term, and one row per field with the exact statistics of all
live units.  A search reads the buckets of its terms only; postings of units
that were replaced or erased drop out by a join of the hits with the live ones.
No text is read or tokenised again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators import retrieval

BUCKETS = 64

POSTINGS = T.StructType([T.StructField("unit_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), T.StructField("len", T.IntegerType()), T.StructField("tf", T.LongType()), T.StructField("generation", T.LongType()), T.StructField("bucket", T.IntegerType())])
LENGTHS = T.StructType([T.StructField("unit_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("len", T.IntegerType()), T.StructField("generation", T.LongType())])
STATS = T.StructType([T.StructField("field", T.StringType()), T.StructField("n_units", T.LongType()), T.StructField("total_len", T.LongType()), T.StructField("generation", T.LongType())])


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TermIndex:
    """The index below one folder; ``live`` tables are (unit_id, generation)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def add(self, units: DataFrame, generation: int) -> None:
        """Append the postings and field lengths of new or replaced units."""
        p = retrieval.postings(units).withColumn("generation", F.lit(generation).cast("long")).withColumn("bucket", bucket(F.col("term")))
        p = p.repartition("bucket").sortWithinPartitions("bucket", "term")
        p.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        n = self._read("postings", POSTINGS).where(F.col("generation") == generation).select("unit_id", "field", "len").distinct()
        n.withColumn("generation", F.lit(generation).cast("long")).write.mode("append").parquet(f"{self.path}/lengths")

    def settle(self, live: DataFrame, generation: int) -> None:
        """Store the statistics of the live units at a generation; a unit without words counts with length 0."""
        lens = self._read("lengths", LENGTHS).join(live, ["unit_id", "generation"], "left_semi")
        total = lens.groupBy("field").agg(F.sum("len").alias("total"))
        fields = self.spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in retrieval.FIELDS])).alias("field"))
        n = live.agg(F.count(F.lit(1)).alias("n_units"))  # one row
        out = fields.join(F.broadcast(n)).join(total, "field", "left")
        out = out.select("field", "n_units", F.coalesce("total", F.lit(0)).cast("long").alias("total_len"), F.lit(generation).cast("long").alias("generation"))
        out.coalesce(1).write.mode("append").parquet(f"{self.path}/stats")

    def search(self, queries: DataFrame, live: DataFrame, generation: int) -> DataFrame:
        """(qid, unit_id, score) of queries(qid, query) among the live units of that (committed) generation."""
        terms = retrieval.query_terms(queries)
        wanted = [r[0] for r in terms.select(bucket(F.col("term"))).distinct().collect()]  # BUCKETS numbers at most
        p = self._read("postings", POSTINGS).where(F.col("bucket").isin(wanted) & (F.col("generation") <= generation))
        p = p.join(terms.select("term").distinct(), "term", "left_semi").join(live, ["unit_id", "generation"], "left_semi")
        stats = self._read("stats", STATS).where(F.col("generation") <= generation)
        last = stats.groupBy("field").agg(F.max(F.struct("generation", "n_units", "total_len")).alias("s"))
        return retrieval.score(p.select("unit_id", "field", "term", "len", "tf"), last.select("field", "s.n_units", "s.total_len"), terms)
