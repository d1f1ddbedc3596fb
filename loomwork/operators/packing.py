"""Intent rules, greedy packing under a budget, and reader views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (pattern on the lower-cased query, class); the first match is the primary intent.
INTENTS = [
    (r"http|@|[0-9a-f]{8}", "identifier"), (r"\bhow (long|many days)\b", "duration"), (r"\bhow many\b", "count"),
    (r"\b(current|now|latest)\b", "current_value"), (r"\b(history|previous|formerly)\b", "history"),
    (r"\b(why|because)\b", "why"), (r"\b(when|date)\b", "temporal"),
]


def intent(query: Column) -> Column:
    out = F.lit("lookup")
    for pattern, name in reversed(INTENTS):
        out = F.when(query.rlike(pattern), name).otherwise(out)
    return out


def pack(ranked: DataFrame, budget: int, most: int = 200) -> DataFrame:
    """(qid, unit_id, rank, tokens, used): rank order, skipping what does not fit.

    ``ranked``: (qid, unit_id, rank, tokens), at most ``most`` ranks a query,
    which bounds each group.  If nothing fits, the first item is taken alone.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        used, keep, sums = 0, [], []
        for t in group["tokens"]:
            ok = used + t <= budget
            used += int(t) if ok else 0
            keep.append(ok)
            sums.append(used)
        if not any(keep) and len(group):
            keep[0], sums[0] = True, int(group["tokens"].iloc[0])
        return group.assign(used=sums)[keep][["qid", "unit_id", "rank", "tokens", "used"]]

    own = ranked.where(F.col("rank") <= most).select("qid", "unit_id", F.col("rank").cast("long").alias("rank"), "tokens")
    return own.groupBy("qid").applyInPandas(one, "qid long, unit_id long, rank long, tokens long, used long")
