"""Half-open interval algebra over two bound columns; a null bound is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = -(1 << 62), 1 << 62


def _bounds(s: Column, e: Column) -> tuple[Column, Column]:
    return F.coalesce(s, F.lit(LOW)), F.coalesce(e, F.lit(HIGH))


def overlaps(s1, e1, s2, e2) -> Column:
    """False where an interval is wholly unknown."""
    a, b = _bounds(s1, e1)
    c, d = _bounds(s2, e2)
    return (a < d) & (c < b) & (s1.isNotNull() | e1.isNotNull()) & (s2.isNotNull() | e2.isNotNull())


def contains_point(s, e, t) -> Column:
    """Three-valued: null where a bound is unknown."""
    return (s <= t) & (t < e)


def allen(s1, e1, s2, e2) -> Column:
    """One of the thirteen relations of two known intervals; else `unknown`."""
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    rules = [
        (e1 < s2, "before"), (e1 == s2, "meets"), (s1 > e2, "after"), (s1 == e2, "met_by"),
        ((s1 == s2) & (e1 == e2), "equals"), ((s1 == s2) & (e1 < e2), "starts"), ((s1 == s2) & (e1 > e2), "started_by"),
        ((e1 == e2) & (s1 > s2), "finishes"), ((e1 == e2) & (s1 < s2), "finished_by"),
        ((s1 > s2) & (e1 < e2), "during"), ((s1 < s2) & (e1 > e2), "contains"), (s1 < s2, "overlaps"),
    ]
    out = F.lit("overlapped_by")
    for cond, name in reversed(rules):
        out = F.when(cond, name).otherwise(out)
    return F.when(known, out).otherwise("unknown")


def t_prox(t, s, e) -> Column:
    """1 at the window's centre, 0 at its bounds and beyond; null when unknown."""
    half = (e - s) / 2
    return F.when(half > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(t - (s + half)) / half)))


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * k, 451)
    n = h + k - 7 * m + 114
    return F.make_date(year, div(n, 31), n % 31 + 1)


def next_monthly(anchor: Column, after: Column) -> Column:
    """First anchor + k months (day clamped) strictly after a date, k >= 0."""
    months = F.floor(F.months_between(F.last_day(after), F.last_day(anchor))).cast("int")
    options = F.transform(F.sequence(F.greatest(months - 1, F.lit(0)), F.greatest(months + 1, F.lit(1))), lambda k: F.add_months(anchor, k))
    return F.array_min(F.filter(options, lambda d: d > after))
