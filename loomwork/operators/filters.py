"""Predicate builders: consumer filter maps and predicate trees become Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"eq": "=", "in": "in", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def consumer_filter(filters: dict, allowed: set[str], created: str) -> Column:
    """Conjunction of equality or membership per key, and exclusive created_after / created_before.

    Unknown keys are an error; an empty map accepts all rows.
    """
    parts = []
    for key, value in filters.items():
        if key == "created_after":
            parts.append(F.col(created) > F.lit(value).cast("timestamp"))
        elif key == "created_before":
            parts.append(F.col(created) < F.lit(value).cast("timestamp"))
        elif key in allowed:
            parts.append(F.col(key).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(key) == value)
        else:
            raise KeyError(f"unknown filter {key!r}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def predicate_tree(tree: dict) -> Column:
    """{"AND": [...]} of {column: {operator: value}} or {column: value}; OR, NOT, ne and contains are refused."""
    if "AND" in tree:
        return reduce(lambda a, b: a & b, map(predicate_tree, tree["AND"]), F.lit(True))
    parts = []
    for key, test in tree.items():
        if key in ("OR", "NOT"):
            raise NotImplementedError(f"{key} is not supported")
        for op, value in (test if isinstance(test, dict) else {"eq": test}).items():
            if op not in OPERATORS:
                raise NotImplementedError(f"operator {op!r} is not supported")
            c = F.col(key)
            parts.append({"eq": lambda: c == value, "in": lambda: c.isin(list(value)), "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value}[op]())
    return reduce(lambda a, b: a & b, parts, F.lit(True))
