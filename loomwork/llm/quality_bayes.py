"""Quality classification by hierarchical empirical Bayes.

A logistic model of whole-text features gives each document's own evidence.
Hosts and paths get Beta posteriors from grouped sums of that evidence over all
documents: a host is shrunk toward the global mean, a path toward its host,
each by a strength that the method of moments finds from the spread of the
group means.  A document's quality is its own log-odds plus its path's
posterior log-odds relative to the global prior; sparse sites add next to
nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.arrow import bound_batches, fresh_names, slices
from loomwork.scratch import Scratch

NAMES = ["log_words", "word_length", "upper", "digits", "marks", "odd_marks", "distinct", "top_word", "line_repeats", "piped", "letters", "long_words", "upper_words", "mark_runs"]
_marks = re.compile(r"[^\w\s]{2,}")


def features(text: str | None) -> list[float]:
    """Shares and rates over the whole text; all zero for an empty one."""
    if not text:
        return [0.0] * len(NAMES)
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    plain = len(raw) - len(raw.translate(None, b".,;:'\"!?-()"))
    odd = len(raw) - len(raw.translate(None, b"#$%&*@^~<>{}[]|\\/+=_`"))
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = 1 - len(set(lines)) / len(lines) if lines else 0.0
    letters = sum(map(len, words))
    pairs = len(_marks.findall(text))
    tall = sum(1 for w in words if w.isupper() and len(w) > 1)
    return [
        float(np.log1p(n)), letters / n, upper / chars, digits / chars, plain / chars, odd / chars, len(count) / n, max(count.values()) / n,
        repeats, count.get("|", 0) / n, letters / chars, sum(1 for w in words if len(w) > 14) / n, tall / n, pairs / n,
    ]


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Logistic:
    """Ridge logistic regression by Newton steps; one class or no rows give a constant."""
    k = x.shape[1] if len(x) else len(NAMES)
    if not len(x) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Logistic(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(p / (1 - p))))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(k + 1)
    penalty = np.diag([ridge] * k + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


def with_features(docs: DataFrame, text_col: str = "text", out_col: str = "features") -> DataFrame:
    """``docs`` without the text, plus its features."""
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text_col, out_col)]
    (hidden,) = fresh_names(keep, "source_text")
    src = docs.select(*keep, F.col(text_col).cast("string").alias(hidden))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, hidden):
            flat = np.array([features(t) for t in b.column(hidden).to_pylist()]).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(NAMES)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], names=[*keep, out_col])

    return src.mapInArrow(run, T.StructType([*src.drop(hidden).schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))]))


def learn(featured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = 20_000) -> Logistic:
    """Fit on about ``sample`` labelled rows (at most twice that reach the driver)."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y"))
    n = known.count()
    h = F.shiftrightunsigned(F.xxhash64("__id", F.lit("quality")), 11) / float(1 << 53)
    drawn = known.where(h < sample / max(n, 1)).limit(2 * sample)
    rows = featured.select(F.col(id_col).alias("__id"), "features").join(drawn, "__id").limit(2 * sample).select("features", "y").toPandas()
    x = np.stack(rows["features"]) if len(rows) else np.zeros((0, len(NAMES)))
    return fit(x, rows["y"].to_numpy(float))


def _posterior(groups: DataFrame, prior: str, strength: float) -> DataFrame:
    return groups.withColumn("post", (F.col("s") + F.lit(strength) * F.col(prior)) / (F.col("n") + F.lit(strength)))


def _strength(groups: DataFrame, prior: str) -> float:
    """Beta strength from the spread of group means beyond sampling noise."""
    mean = F.col("s") / F.col("n")
    r = groups.agg(
        F.sum(F.col("n") * F.pow(mean - F.col(prior), 2)).alias("between"),
        F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))).alias("within"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.pow(F.col("n").cast("double"), 2)).alias("n2"),
    ).first()
    if not r["k"] or r["k"] < 2:
        return 1e6
    level = r["within"] / r["n"]  # mean p (1 - p)
    # E[between] = k * level + tau2 * (n - n2 / n), with between-group variance tau2
    tau2 = (r["between"] - r["k"] * level) / max(r["n"] - r["n2"] / r["n"], 1e-9)
    return float(np.clip(level / tau2 - 1, 1.0, 1e6)) if tau2 > 0 else 1e6


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5
) -> DataFrame:
    """(id, doc_score, host_score, path_score, quality, keep) of every document.

    Null hosts or paths form a group of their own.  An empty or null text has
    all-zero features and the score these get.  Without labels, or with one
    class, every document has the smoothed base rate.  Repeated ids are
    separate rows.  An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    narrow = docs.select(F.col(id_col).alias("id"), part(host_col).alias("host"), part(path_col).alias("path"), F.col(text_col).alias("text"))
    own = scratch.save(with_features(narrow), "features")
    model = learn(own.withColumnRenamed("id", id_col), labels, id_col)
    w, b = model.weights / model.scale, model.bias - float((model.weights * model.mean / model.scale).sum())
    z = sum((F.col("features")[i] * float(x) for i, x in enumerate(w)), F.lit(b))
    own = own.select("id", "host", "path", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("p"))
    paths = own.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n"))
    paths = scratch.save(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = min(max(total["s"] / total["n"], 1e-6), 1 - 1e-6) if total["n"] else 0.5
    hosts = hosts.withColumn("prior", F.lit(prior))
    hosts = _posterior(hosts, "prior", _strength(hosts, "prior")).select("host", F.col("post").alias("host_post"))
    hosts = scratch.save(hosts, "hosts")
    sites = paths.join(hosts, "host")
    sites = _posterior(sites, "host_post", _strength(sites, "host_post")).select("host", "path", "host_post", F.col("post").alias("path_post"))
    sites = scratch.save(sites, "sites")
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    out = own.join(sites, ["host", "path"])
    joint = odds(F.col("p")) + odds(F.col("path_post")) - float(np.log(prior / (1 - prior)))
    out = out.withColumn("quality", 1 / (1 + F.exp(-joint)))
    return out.select("id", F.col("p").alias("doc_score"), F.col("host_post").alias("host_score"), F.col("path_post").alias("path_score"), "quality", (F.col("quality") >= threshold).alias("keep"))


def op8_quality_bayes(spark, sf_dir: str) -> DataFrame:
    out = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumnRenamed("id", "doc_id")
