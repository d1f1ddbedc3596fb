"""The engine's facade: a folder of Parquet tables, one generation per ingest.

    e = Engine(spark, path)
    e.ingest(df)                      # unit_id, session_id, seq, speaker, text
    e.search("some words")            # or a DataFrame of (qid, query)
    e.forget(ids); e.units(); e.dedup(); e.status()
    e.inspect(unit_id); e.backup(path)

A generation becomes visible by one last write, its row in ``commits``: what a
failed ingest left behind is never read, and an idempotency key that was
committed before gives its first receipt again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators import dedup, retrieval
from loomwork.operators.index import TermIndex

UNITS = T.StructType([
    T.StructField("unit_id", T.LongType()), T.StructField("session_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()), T.StructField("generation", T.LongType()),
])
COMMITS = T.StructType([T.StructField("generation", T.LongType()), T.StructField("key", T.StringType())])
GONE = T.StructType([T.StructField("unit_id", T.LongType()), T.StructField("generation", T.LongType())])


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.index = TermIndex(spark, f"{self.path}/index")

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def _visible(self, table: str, schema: T.StructType, as_of: int | None) -> DataFrame:
        commits = self._read("commits", COMMITS).select("generation").distinct()
        rows = self._read(table, schema)
        return (rows if as_of is None else rows.where(F.col("generation") <= as_of)).join(commits, "generation", "left_semi")

    def generation(self, as_of: int | None = None) -> int:
        """The newest generation that is committed (up to ``as_of``)."""
        c = self._read("commits", COMMITS)
        return (c if as_of is None else c.where(F.col("generation") <= as_of)).agg(F.max("generation")).first()[0] or 0

    def _next(self) -> int:
        """A number that no generation has, failed ones included."""
        seen = [self._read(t, s).agg(F.max("generation")).first()[0] or 0 for t, s in (("units", UNITS), ("erased", GONE), ("commits", COMMITS))]
        return max(seen) + 1

    def _commit(self, g: int, key: str | None) -> int:
        row = self.spark.range(1).select(F.lit(g).cast("long").alias("generation"), F.lit(key).cast("string").alias("key"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return g

    def ingest(self, rows: DataFrame, key: str | None = None) -> int:
        """Append a generation; a later row of a unit replaces the earlier one.

        Returns the generation, or that of the first ingest with the same ``key``.
        """
        if key is not None:
            done = self._read("commits", COMMITS).where(F.col("key") == key).agg(F.min("generation")).first()[0]
            if done is not None:
                return done
        g = self._next()
        known = set(rows.columns)
        cols = [(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in UNITS.fields[:-1]]
        rows.select(*cols, F.lit(g).cast("long").alias("generation")).dropDuplicates(["unit_id"]).write.mode("append").parquet(f"{self.path}/units")
        self.index.add(self._read("units", UNITS).where(F.col("generation") == g), g)
        self.index.settle(self.live(extra=g), g)
        return self._commit(g, key)

    def forget(self, ids: DataFrame) -> int:
        """Erase units by (unit_id); an erased unit returns only if ingested again."""
        g = self._next()
        ids.select(F.col("unit_id").cast("long").alias("unit_id"), F.lit(g).cast("long").alias("generation")).distinct().write.mode("append").parquet(f"{self.path}/erased")
        self.index.settle(self.live(extra=g), g)
        return self._commit(g, None)

    def live(self, as_of: int | None = None, extra: int | None = None) -> DataFrame:
        """(unit_id, generation): the newest version of every unit that is not erased.

        Committed generations count, and ``extra``, the one about to be.
        """
        def seen(table: str, schema: T.StructType) -> DataFrame:
            rows = self._visible(table, schema, as_of)
            return rows if extra is None else rows.unionByName(self._read(table, schema).where(F.col("generation") == extra))

        u = seen("units", UNITS).groupBy("unit_id").agg(F.max("generation").alias("generation"))
        gone = seen("erased", GONE).groupBy("unit_id").agg(F.max("generation").alias("erased"))
        return u.join(gone, "unit_id", "left").where("erased is null or erased < generation").select("unit_id", "generation")

    def units(self, as_of: int | None = None) -> DataFrame:
        """Live units at a generation (the newest by default)."""
        return self._read("units", UNITS).join(self.live(as_of), ["unit_id", "generation"], "left_semi").select(*[f.name for f in UNITS])

    def inspect(self, unit_id: int) -> DataFrame:
        """(generation, event, text): every version and erasure of a unit, oldest first; the key reaches the scans."""
        v = self._visible("units", UNITS, None).where(F.col("unit_id") == unit_id).select("generation", F.lit("stored").alias("event"), "text")
        e = self._visible("erased", GONE, None).where(F.col("unit_id") == unit_id).select("generation", F.lit("erased").alias("event"), F.lit(None).cast("string").alias("text"))
        return v.unionByName(e).orderBy("generation")

    def backup(self, path: str) -> Engine:
        """A store at ``path`` with this one's live units as one generation."""
        copy = Engine(self.spark, path)
        if copy.generation():
            raise ValueError("the folder already holds a store")
        copy.ingest(self.units())
        return copy

    def search(self, query: str | DataFrame, limit: int = 10, context: bool = False, as_of: int | None = None) -> DataFrame:
        """(qid, rank, unit_id, score, text) of the best units."""
        q = query if isinstance(query, DataFrame) else self.spark.range(1).select(F.lit(0).cast("long").alias("qid"), F.lit(query).alias("query"))
        u = self.units(as_of)
        at = self.generation(as_of)
        s = self.index.search(q, self.live(as_of), at)
        if context:
            s = retrieval.propagate(retrieval.top(s, 50), u)
        return retrieval.top(s, limit).join(u.select("unit_id", "text"), "unit_id").select("qid", "rank", "unit_id", "score", "text")

    def dedup(self) -> DataFrame:
        """(id, group_id, n): exact duplicate groups of the live units."""
        return dedup.exact_groups(self.units(), "unit_id", "text")

    def status(self) -> DataFrame:
        return self.units().agg(F.count(F.lit(1)).alias("units"), F.countDistinct("session_id").alias("sessions"), F.max("generation").alias("generation"))
