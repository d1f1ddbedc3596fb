"""Registered extraction of preferences, states and standing rules.

The statements are written from the events: each event type states another
thing, so that the SQL side knows what must be found.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import facts, temporal
from loomwork.plans.registry import load, query

FOODS = ["tea", "rice", "fish", "bread", "soup", "plums", "oats"]
FOOD = "[" + ", ".join(f"'{x}'" for x in FOODS) + "][(event_id % 7 + 1)::INTEGER]"


def _statements(spark, d):
    food = F.element_at(F.array(*map(F.lit, FOODS)), (F.col("event_id") % 7 + 1).cast("int"))
    said = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Well. I love "), food, F.lit(". Do I like rice?")))
        .when(F.col("event_type") == "view", F.concat(F.lit("I do not like "), food, F.lit("!")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("I moved to town "), (F.col("event_id") % 5).cast("string"), F.lit(". I have a cat.")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Always send "), food, F.lit(" reports.")))
        .otherwise(F.concat(F.lit("Forget the rule about "), food, F.lit(" reports.")))
    )
    return load(spark, d, "events").select(F.col("event_id").alias("unit_id"), F.col("user_id").alias("subject"), temporal.micros(F.col("ts")).alias("us"), said.alias("text"))


PREFS = f"p AS (SELECT event_id, user_id AS subject, {FOOD} AS object, event_type = 'click' AS positive, CASE event_type WHEN 'click' THEN 3 ELSE 2 END AS rank, epoch_us(ts) AS us FROM events WHERE event_type IN ('click', 'view'))"


@query("preferences", f"WITH {PREFS} SELECT subject, object, CASE rank WHEN 3 THEN 'love_hate' ELSE 'like_dislike' END AS strength, positive, event_id AS unit_id FROM (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY rank DESC, us DESC, event_id DESC) AS r FROM p) WHERE r = 1")
def preferences(spark, d):
    return facts.strongest(facts.preferences(_statements(spark, d)))


@query("state_facts", """WITH p AS (SELECT event_id, user_id, event_id % 5 AS n, ts FROM events WHERE event_type = 'purchase')
SELECT event_id AS unit_id, user_id AS subject, 'home' AS family, 'town ' || n AS value, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 'current' ELSE 'historical' END AS status FROM p
UNION ALL SELECT event_id, user_id, 'pets', 'cat', 'current' FROM p""")
def state_facts(spark, d):
    return facts.current(facts.states(_statements(spark, d))).select("unit_id", "subject", "family", "value", "status")


@query("standing_rules", f"""WITH r AS (SELECT event_id, user_id, {FOOD} AS food, epoch_us(ts) AS us FROM events WHERE event_type = 'signup'), x AS (SELECT user_id, {FOOD} AS food, epoch_us(ts) AS us FROM events WHERE event_type = 'error')
SELECT r.event_id AS unit_id, r.user_id AS subject, 'send ' || r.food || ' reports' AS body, min(x.us) AS revoked_us FROM r LEFT JOIN x ON x.user_id = r.user_id AND x.food = r.food AND x.us > r.us GROUP BY 1, 2, 3""")
def standing_rules(spark, d):
    return facts.standing_rules(_statements(spark, d)).select("unit_id", "subject", "body", "revoked_us")
