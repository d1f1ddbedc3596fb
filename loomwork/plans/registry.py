"""All registered queries of the engine proper, with their SQL oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "search_bm25f"


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame callable and its SQL."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


from loomwork.plans import answers, classify, composite, evaluation, evidence, exchange, extraction, facts, governance, lanes, linking, policy, relational, retrieval, sieving, standard, statements, textual, trials, versions  # noqa: E402, F401
