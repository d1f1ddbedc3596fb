"""Event tuples, pronoun antecedents and near-equal texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Families of event verbs with their past forms; a negation before the verb turns the polarity.
FAMILIES = {
    "acquire": "bought got ordered received adopted", "move": "moved travelled flew drove went", "start": "started began joined launched opened",
    "end": "finished ended left quit closed", "meet": "met visited called saw", "make": "made built wrote cooked painted",
}
NAME = r"\p{Lu}\p{Ll}+"
PRONOUN = r"\b(he|she|him|her|his|hers)\b"


def events(units: DataFrame) -> DataFrame:
    """(unit_id, subject, family, verb, object, negated): one tuple per event that a text states.

    The subject is the capitalised name before the verb, else the unit's
    speaker for "I" and "we"; without either there is no tuple.
    """
    def all_of(family: str, verbs: str):
        p = rf"\b(I|We|we|{NAME}) (never |also |just |)({verbs.replace(' ', '|')}) (?:to |with |the |an? |my |)([\p{{L}}0-9'\-]+)"
        part = lambda k: F.regexp_extract_all("text", F.lit(p), F.lit(k))
        hits = F.arrays_zip(part(1).alias("who"), part(2).alias("mood"), part(3).alias("verb"), part(4).alias("object"))
        return F.transform(hits, lambda h: F.struct(h["who"].alias("who"), F.lit(family).alias("family"), h["verb"].alias("verb"), F.lower(h["object"]).alias("object"), (h["mood"] == "never ").alias("negated")))

    found = F.flatten(F.array(*[all_of(f, v) for f, v in FAMILIES.items()]))
    rows = units.select("unit_id", "speaker", F.explode(found).alias("e"))
    who = F.when(F.col("e.who").isin("I", "We", "we"), F.lower("speaker")).otherwise(F.lower("e.who"))
    return rows.select("unit_id", who.alias("subject"), "e.family", "e.verb", "e.object", "e.negated").where("subject is not null")


def antecedents(units: DataFrame, lookback: int = 6) -> DataFrame:
    """(unit_id, antecedent): for units with a pronoun, the one name of the turns before.

    Names of the last ``lookback`` turns of the session count; with several or
    none the sieve abstains (null).
    """
    w = W.partitionBy("session_id").orderBy("seq", "unit_id").rowsBetween(-lookback, -1)
    # a name opens no sentence here: first words are capitalised anyhow
    own = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"[\p{{Ll}},;] ({NAME})"), F.lit(1)))
    u = units.select("unit_id", F.array_distinct(F.flatten(F.collect_list(own).over(w))).alias("names"), F.lower(F.coalesce("text", F.lit(""))).rlike(PRONOUN).alias("asks"))
    return u.where("asks").select("unit_id", F.when(F.size("names") == 1, F.element_at("names", 1)).alias("antecedent"))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio(a: str, b: str) -> Column:
    """Matching-blocks similarity of two text columns, 0 to 1; null where either is null."""
    return F.pandas_udf(_ratios, "double")(F.col(a), F.col(b))


def repair(kept: DataFrame, rows: DataFrame, changed: DataFrame, keys: list[str], aggregate) -> DataFrame:
    """``kept`` with the groups of ``changed`` keys computed anew from ``rows``; the others are untouched.

    ``aggregate`` maps rows to one row per group; a group without rows goes.
    """
    touched = changed.select(*keys).distinct()
    fresh = aggregate(rows.join(touched, keys, "left_semi"))
    return kept.join(touched, keys, "left_anti").unionByName(fresh)
