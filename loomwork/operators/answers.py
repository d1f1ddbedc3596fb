"""From ranked candidates to an answer: signals, seeds, support, status, computed values, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reserve(ranked: DataFrame, cap: int, share: float = 0.5) -> DataFrame:
    """(qid, unit_id): the first ``cap`` by rank, but facet-tagged rows keep ``share`` of the slots.

    ``ranked``: (qid, unit_id, rank, tagged).  Tagged rows in the reserved slots
    come first; what is left is filled by rank, whatever the tag.
    """
    own = F.row_number().over(W.partitionBy("qid", "tagged").orderBy("rank"))
    r = ranked.withColumn("held", F.col("tagged") & (own <= int(cap * share)))
    order = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("held"), "rank"))
    return r.withColumn("o", order).where(F.col("o") <= cap).select("qid", "unit_id")


def union_signals(rows: DataFrame, key: str, lane: str, fact: str, members: str, feature: str) -> DataFrame:
    """One row a key: the first lane's fact that is not null, the union of sets, the largest feature."""
    first = F.min_by(fact, F.when(F.col(fact).isNotNull(), F.col(lane)))
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_set(members))))
    return rows.groupBy(key).agg(first.alias("fact"), union.alias("members"), F.max(feature).alias("feature"))


def quota(rows: DataFrame, per: int) -> DataFrame:
    """(qid, unit_id): units that some canon of theirs admits among its first ``per`` by score; joint units (two canons or more) are free.

    ``rows``: (qid, canon, unit_id, score).
    """
    hits = rows.groupBy("qid", "unit_id").agg(F.count(F.lit(1)).alias("hits"))
    r = rows.join(hits, ["qid", "unit_id"])
    single = r.where("hits = 1").withColumn("r", F.row_number().over(W.partitionBy("qid", "canon").orderBy(F.desc("score"), "unit_id")))
    return single.where(F.col("r") <= per).select("qid", "unit_id").unionByName(hits.where("hits > 1").select("qid", "unit_id"))


def support(row: dict[str, Column]) -> Column:
    """Label of an evidence group.

    Keys: asked, matched (identifiers), cov (term coverage), ent (entity
    coverage), window, real (lane support), measured, only (an entity-only query).
    """
    asked, matched, cov, ent = row["asked"], row["matched"], row["cov"], row["ent"]
    whole = ent >= 1
    with_ids = (
        F.when(matched == asked, "supported").when(matched > 0, "partial")
        .when((cov >= 0.5) | whole | ~row["measured"], "partial").otherwise("weak")
    )
    supported = (cov >= 0.6) | ((cov >= 0.4) & row["real"]) | (row["window"] & (cov >= 0.5)) | (whole & (cov >= 0.25)) | (row["only"] & whole & row["real"])
    partial = (cov >= 0.25) | (ent >= 0.5) | row["window"] | row["real"]
    return F.when(asked > 0, with_ids).when(supported, "supported").when(partial, "partial").otherwise("weak")


def answerability(candidates: Column, contradicted: Column, supported: Column, premise_open: Column, partial: Column) -> Column:
    """The first that holds."""
    return (
        F.when(candidates == 0, "no_evidence").when(contradicted, "contradicted_premise").when(supported, "supported")
        .when(premise_open, "unverified_premise").when(partial, "partial").otherwise("weak_only")
    )


def relation(prior: dict[str, Column], new: dict[str, Column], shared_entity: Column) -> Column:
    """How a new statement updates a prior one; null for no relation.

    Keys of both: words, values (arrays of tokens), negated, at (event time).
    """
    shared = F.size(F.array_intersect(prior["words"], new["words"]))
    only_old, only_new = F.array_except(prior["words"], new["words"]), F.array_except(new["words"], prior["words"])
    related = (shared >= 2) | ((shared == 1) & shared_entity)
    values = (F.size(only_old) > 0) & (F.size(F.array_except(only_old, prior["values"])) == 0) & (F.size(only_new) > 0)
    kind = (
        F.when(~prior["negated"] & new["negated"], "negates").when(prior["negated"] & ~new["negated"], "contradicts")
        .when(values, "newer_value").when((F.size(only_old) > 0) & (F.size(only_new) > 0), "contradicts")
        .when(F.size(only_new) > 0, "refines").when((F.size(only_old) == 0) & (prior["at"] != new["at"]), "newer_value")
    )
    return F.when(related, kind)


def computed(items: DataFrame, key: str) -> DataFrame:
    """(key, n, order, days, current, before) of dated items (ref, at, value, state).

    n counts distinct refs and, like the order, needs two; days are whole UTC
    days from first to last; current is the newest value, before the ones it
    replaced, newest first.
    """
    refs = items.groupBy(key, "ref").agg(F.min(F.struct("at", "ref")).alias("first"), F.max(F.struct("at", "ref", "value")).alias("last"))
    g = refs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("first")).alias("seq"), F.min("first.at").alias("lo"), F.max("last.at").alias("hi"),
        F.reverse(F.array_sort(F.collect_list("last"))).alias("newest"),
    )
    two = F.col("n") >= 2
    return g.select(
        key, F.when(two, F.col("n")).alias("n"), F.when(two, F.array_join(F.transform("seq", lambda x: x["ref"]), ">")).alias("order"),
        F.floor((F.unix_micros("hi") - F.unix_micros("lo")) / 86_400_000_000).cast("long").alias("days"),
        F.col("newest")[0]["value"].alias("current"), F.size("newest").cast("long").alias("versions"),
    )


def close_sentences(text: Column, budget: int) -> Column:
    """The longest run of whole sentences from the start within ``budget`` tokens of four bytes; the first alone if longer."""
    s = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    start = F.struct(F.lit("").alias("kept"), F.lit(True).alias("open"))

    def step(a: Column, x: Column) -> Column:
        longer = F.concat(a["kept"], x)
        fits = a["open"] & (F.ceil(F.octet_length(longer) / 4) <= budget)
        return F.struct(F.when(fits, longer).otherwise(a["kept"]).alias("kept"), fits.alias("open"))

    kept = F.aggregate(s, start, step, lambda a: a["kept"])
    return F.when((kept == "") & (F.size(s) > 0), s[0]).otherwise(kept)
