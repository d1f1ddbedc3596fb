"""Preferences, state facts and standing rules stated in the first person.

One regular expression per kind, in a fixed order, over sentences; the rules
cover plain statements only and abstain on questions.  All of it runs inside
the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text

SENTENCE = r"[^.!?\n]+[.!?]*"
TAIL = r"([\p{L}0-9][\p{L}0-9 '\-]*)"
# (strength, rank, pattern): the object is the last group, a negation the first; stronger kinds come first.
PREFERENCES = [
    ("constraint", 5, r"\bi (can|can't|cannot|must|must not) (?:eat|drink|use|have|stand) " + TAIL),
    ("favorite", 4, r"\bmy (|least )favou?rite [a-z]+ (?:is|are) " + TAIL),
    ("love_hate", 3, r"\bi (do not |don't |never |)(?:really )?(?:love|adore|hate|detest) " + TAIL),
    ("like_dislike", 2, r"\bi (do not |don't |never |)(?:really )?(?:like|enjoy|prefer|dislike) " + TAIL),
    ("habitual", 1, r"\bi (never |rarely |)(?:always|usually|often) (?:eat|drink|use|take|buy) " + TAIL),
]
AGAINST = r"^(can't|cannot|must not|least |do not |don't |never |rarely )$"
DISLIKE = r"\b(hate|detest|dislike)\b"
# (family, mode, pattern): replace keeps the newest value, accumulate all of them, numeric compares numbers.
STATES = [
    ("age", "numeric", r"\bi(?: am|'m) ([0-9]{1,3})(?: years old)?\b"),
    ("home", "replace", r"\bi (?:live in|moved to|have moved to) " + TAIL),
    ("job", "replace", r"\bi (?:work as|started as) an? " + TAIL),
    ("employer", "replace", r"\bi (?:work for|work at|joined) " + TAIL),
    ("pets", "accumulate", r"\bi (?:have|got|adopted) an? (dog|cat|bird|rabbit|fish|horse|hamster|turtle)\b"),
    ("languages", "accumulate", r"\bi (?:speak|am learning) " + TAIL),
    ("visited", "accumulate", r"\bi have visited " + TAIL),
    ("allergies", "accumulate", r"\bi(?: am|'m) allergic to " + TAIL),
]
RULE = r"^\s*(?:please )?(always|never|do not|don't|from now on,?) " + TAIL
REVOKE = r"^\s*(?:never mind|forget|disregard|no longer) (?:the rule )?(?:about |to |that )?" + TAIL


def sentences(units: DataFrame) -> DataFrame:
    """(unit_id, subject, us, place, sentence): lower-cased statements; questions are left out."""
    s = units.select("unit_id", "subject", "us", F.posexplode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(SENTENCE), F.lit(0))).alias("place", "sentence"))
    return s.where(~F.endswith(F.rtrim("sentence"), F.lit("?")))


def preferences(units: DataFrame) -> DataFrame:
    """(unit_id, subject, object, strength, rank, positive, us): the strongest preference of each sentence.

    A negated dislike abstains.  Units: (unit_id, subject, us, text); null and
    empty texts give nothing.
    """
    s = sentences(units)
    found = F.array(*[F.when(F.col("sentence").rlike(p), F.struct(F.lit(n).alias("strength"), F.lit(r).alias("rank"), F.trim(F.regexp_extract("sentence", p, 2)).alias("object"),
                      F.regexp_extract("sentence", p, 1).rlike(AGAINST).alias("no"), F.regexp_extract("sentence", p, 0).rlike(DISLIKE).alias("bad"))) for n, r, p in PREFERENCES])
    best = s.withColumn("p", F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))).where("p is not null and not (p.no and p.bad)")
    return best.select("unit_id", "subject", "p.object", "p.strength", "p.rank", (~F.col("p.no") & ~F.col("p.bad")).alias("positive"), "us")


def strongest(found: DataFrame) -> DataFrame:
    """One row per (subject, object): the strongest statement, the newest among equals."""
    best = F.max(F.struct("rank", "us", "unit_id", "strength", "positive"))
    return found.groupBy("subject", "object").agg(best.alias("b")).select("subject", "object", "b.strength", "b.positive", "b.unit_id")


def states(units: DataFrame) -> DataFrame:
    """(unit_id, subject, family, mode, value, us): every state statement."""
    s = sentences(units)
    found = F.array(*[F.when(F.col("sentence").rlike(p), F.struct(F.lit(n).alias("family"), F.lit(m).alias("mode"), F.trim(F.regexp_extract("sentence", p, 1)).alias("value"))) for n, m, p in STATES])
    return s.select("unit_id", "subject", "us", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("unit_id", "subject", "f.*", "us")


def current(facts: DataFrame) -> DataFrame:
    """``facts`` with ``status``: of replace and numeric families the newest value is current; accumulated values all are."""
    r = F.row_number().over(W.partitionBy("subject", "family").orderBy(F.desc("us"), F.desc("unit_id"), "value"))
    return facts.withColumn("status", F.when((F.col("mode") == "accumulate") | (r == 1), "current").otherwise("historical"))


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller token set that both texts hold."""
    x, y = F.array_distinct(text.tokens(a)), F.array_distinct(text.tokens(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1))


def standing_rules(units: DataFrame, least: float = 0.7) -> DataFrame:
    """(unit_id, subject, place, kind, body, us, revoked_us): imperative rules and when each was revoked.

    A revocation ends the subject's earlier rules whose body shares ``least`` of
    its tokens.  Both meet on the subject and a shared token.
    """
    s = sentences(units)
    kind = F.when(F.regexp_extract("sentence", RULE, 1).rlike("^(never|do not|don't)"), "prohibition").otherwise("obligation")
    rules = s.where(F.col("sentence").rlike(RULE)).select("unit_id", "subject", "place", kind.alias("kind"), F.trim(F.regexp_extract("sentence", RULE, 2)).alias("body"), "us")
    ends = s.where(F.col("sentence").rlike(REVOKE)).select("subject", F.trim(F.regexp_extract("sentence", REVOKE, 1)).alias("what"), F.col("us").alias("end"))
    key = lambda c: F.explode(F.array_distinct(text.tokens(F.col(c)))).alias("token")
    met = rules.select("*", key("body")).join(ends.select("*", key("what")), ["subject", "token"]).where("end > us").drop("token").distinct()
    gone = met.where(overlap(F.col("body"), F.col("what")) >= least).groupBy("unit_id", "place").agg(F.min("end").alias("revoked_us"))
    return rules.join(gone, ["unit_id", "place"], "left").select("unit_id", "subject", "place", "kind", "body", "us", "revoked_us")
