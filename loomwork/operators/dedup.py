"""Exact and near duplicate groups of units."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text


def exact_groups(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, group_id, n): rows of equal normalised text; the group is its smallest id."""
    own = rows.select(F.col(id_col).alias("id"), text.digest(F.col(text_col)).alias("digest"))
    groups = own.groupBy("digest").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    return own.join(groups, "digest").select("id", "group_id", "n")


def classes(rows: DataFrame, id_col: str, text_col: str, k: int = 3) -> DataFrame:
    """(id, class_id): rows of equal shingle sets share their smallest id; rows without words are left out."""
    own = rows.select(F.col(id_col).alias("id"), F.array_sort(text.shingles(text.tokens(F.col(text_col)), k)).alias("s")).where(F.size("s") > 0)
    own = own.select("id", F.sha2(F.to_json(F.struct("s")), 256).alias("h"))
    return own.join(own.groupBy("h").agg(F.min("id").alias("class_id")), "h").select("id", "class_id")


def near_links(rows: DataFrame, id_col: str, text_col: str, k: int = 3, least: float = 0.85) -> DataFrame:
    """(a, b, jaccard) between representatives of equal shingle sets, a < b.

    Prefix filter: with shingles in a fixed order, two sets of Jaccard >= t
    share one of their first n - ceil(t n) + 1 shingles; rare shingles first
    keeps the join's keys small.
    """
    own = rows.select(F.col(id_col).alias("id"), F.array_sort(text.shingles(text.tokens(F.col(text_col)), k)).alias("s")).where(F.size("s") > 0)
    reps = own.groupBy("s").agg(F.min("id").alias("id"))
    flat = reps.select("id", F.size("s").alias("n"), F.explode("s").alias("x"))
    df = flat.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ordered = flat.join(df, "x").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))
    need = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1
    prefix = ordered.select("id", "n", F.explode(F.slice("o", 1, need)).alias("p")).where("p.df > 1").select("id", "n", "p.x")
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "x"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "x")
    sized = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least)
    pairs = a.join(b, "x").where(sized).select("a", "b").distinct()
    sets = reps.select("id", "s")
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return pairs.withColumn("jaccard", text.jaccard(F.col("sa"), F.col("sb"))).where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def _window_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit polynomial hash of every run of k characters, by doubling."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, done, power, base = np.zeros(len(c) + 1, np.uint64), 0, 1, 0x9E3779B97F4A7C15
    part, n, step = c + np.uint64(1), 1, base
    while True:  # out: of the first `done` characters, part: of the next n
        if k & n:
            out = out[: len(c) - done - n + 1] * np.uint64(step) + part[done : len(c) - n + 1]
            done += n
        if done == k:
            return out
        part = part[:-n] * np.uint64(step) + part[n:]
        n, step = 2 * n, step * step % 2**64


def grams_among(docs: DataFrame, grams: DataFrame, k: int) -> DataFrame:
    """(doc_id, gram): the distinct runs of k characters of docs(doc_id, text) that may be in grams(gram), all that are among them.

    2^20 flags of the grams' hashes reach every task, whatever their number; an
    equi-join on the gram decides.
    """

    def flag(batches):
        for b in batches:
            h = [int(_window_hashes(g, k)[0] >> np.uint64(44)) for g in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(h)), pa.int32())], names=["h"])

    wanted = np.zeros(1 << 20, bool)
    wanted[[r["h"] for r in grams.select("gram").where(F.length("gram") == k).distinct().mapInArrow(flag, "h int").distinct().collect()]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        flags = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            rows, found = [], []
            for r, t in enumerate(b.column(1)):
                t = t.as_py()
                if t is None or len(t) < k:
                    continue
                hit = {t[i : i + k] for i in np.flatnonzero(flags[_window_hashes(t, k) >> np.uint64(44)])}
                rows.extend([r] * len(hit))
                found.extend(hit)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["doc_id", "gram"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, gram string")
