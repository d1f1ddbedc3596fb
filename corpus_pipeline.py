"""Corpus pipeline: five stages over ``documents``, each an operator of loomwork.llm.

language ID -> SimHash near-dedup -> secret redaction -> source mixing ->
SentencePiece ids.  Every stage but the last returns the columns of documents,
whatever further columns these have: an operator's own columns get names that
the input does not use.  An empty table passes all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork import scratch as scratches
from loomwork.llm import language_crf, mixing, secrets, sentencepiece_trie, simhash_sets
from loomwork.llm.arrow import fresh_names
from loomwork.scratch import Scratch

#: A text goes if no language reaches this mean posterior; code-switched texts stay.
LEAST_LANGUAGE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters or without a leading language; the rest is unchanged.

    A null text has no letters and goes; null labels and ids are never learned
    from, and if nothing can be learned no language leads, so that all go.
    Repeated rows are judged alike.
    """
    pred, score = fresh_names(docs.columns, "lang_pred", "lang_score")
    model = language_crf.learn(docs.where(~F.coalesce(language_crf.held_out(), F.lit(False))))
    out = language_crf.label(docs, model, pred_col=pred, score_col=score)
    return out.where((F.col(pred) != "und") & (F.col(score) >= LEAST_LANGUAGE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies.

    Near copies share 0.8 or more of their five-word shingles (exact Jaccard).
    Of repeated rows (equal id and text) one stays; of different texts with one
    id each is judged by itself; null and word-free texts are copies of each
    other; rows with a null id stay.
    """
    th, id_ = fresh_names(docs.columns, "text_hash", "kept_id")
    found = simhash_sets.near_copies(docs).where("id = component").select(F.col("id").alias(id_), "th").distinct()
    found = found.select(id_, F.col("th").alias(th + "_kept"))
    hashed = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    kept = hashed.join(found, (F.col("doc_id") == F.col(id_)) & (F.col(th) == F.col(th + "_kept")), "left_semi")
    kept = kept.dropDuplicates(["doc_id", th]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; n_chars follows the text.

    A null or empty text stays as it is; repeated rows are redacted alike.  Texts
    are scanned twice, as the false-discovery limits need all findings before the
    first text can be changed; a written copy would double the disk instead.
    """
    found = secrets.scan(docs.select("text", F.struct(*docs.columns).alias("row")))
    text = secrets.redact(F.col("text"), F.col("spans"))
    kinds = dict(docs.dtypes)
    out = found.select("row", "spans", text.alias("text"))
    made = {"text": F.col("text")}
    if "n_chars" in kinds:
        length = F.when(F.size("spans") > 0, F.char_length("text")).otherwise(F.col("row")["n_chars"])
        made["n_chars"] = length.cast(kinds["n_chars"])
    return out.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _mixture(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, mix_*): the schedule depends on the set of rows only."""
    return mixing.mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair mixture of their sources.

    A null source is a source of its own; null ids and repeated rows are rows
    like others.
    """
    return _mixture(docs).orderBy("mix_position").select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, with its slot and position in the mixture.

    Files have no defined order when read again, so the schedule of mix_sources,
    which depends on the set of rows only, is worked out once more and returned.
    A null text has null ids and n_tokens null, an empty one no ids; other
    columns of documents are left out.
    """
    mixed = _mixture(docs).select("doc_id", "source", F.col("row")["lang"].alias("lang"), F.col("row")["text"].alias("text"), "mix_slot", "mix_position")
    out = sentencepiece_trie.encode(mixed)
    n = F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long")
    return out.select("doc_id", "source", "lang", n.alias("n_tokens"), "ids", "mix_slot", "mix_position")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: Not expressible in SQL: stages learn, iterate or schedule; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, last = Scratch(spark, "pipeline"), ""
    for name, stage in STAGES[:-1]:
        since = scratches.mark()
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratches.sweep(since)  # the stage's own tables, and its input
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
