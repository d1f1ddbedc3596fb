"""Natural-language time phrases to half-open UTC intervals.

``resolve(text, anchor)`` gives (phrase, start_us, end_us, precision) in text
order; a phrase without a bound has a null one.  Rules: ISO dates and
date-times, Month YYYY, bare years and decades, bare months (latest on or
before the anchor), today / yesterday / tomorrow, N units ago or in N units,
last / this / next week, weekend, month and year, weekdays (bare: the latest
before the anchor), seasons, a few or a couple of units ago, recently, the other
day, thirds and numbered weeks of months, units before or after a phrase, since,
until, before, after and through, from-to and between, and fixed or computed
holidays.  Durations, ages and vague phrases are kept with null bounds.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTHS = [m.lower() for m in calendar.month_name]
DAYS = [x.lower() for x in calendar.day_name]
# Meteorological seasons of the northern hemisphere (first month), fixed holidays.
SEASONS = {"spring": 3, "summer": 6, "autumn": 9, "fall": 9, "winter": 12}
HOLIDAYS = {"christmas": (12, 25), "new year's day": (1, 1), "halloween": (10, 31), "valentine's day": (2, 14)}
_month = "|".join(MONTHS[1:])
_num = "a|an|one|two|three|four|five|six|seven|eight|nine|ten|\\d{1,3}"
WORDS = ["", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
# Phrases that name no span.
VAGUE = "someday|sooner or later|eventually|these days|nowadays|a while ago|long ago|at some point|in the future|in the past|back then"
_ord = ["first", "second", "third", "fourth", "fifth", "last"]
_units = "day|week|month|year"
_phrases = re.compile(
    rf"\b(?P<thirds>(?:early|mid|late)[ -](?:(?:{_month})(?: (?:1[89]|20)\d{{2}})?|(?:1[89]|20)\d{{2}}))\b|\b(?P<nth>(?:{'|'.join(_ord)}) week of (?:{_month})(?: (?:1[89]|20)\d{{2}})?)\b"
    rf"|\b(?P<few>(?:a few|several|a couple(?: of)?) (?:{_units})s ago)\b|\b(?P<recent>recently|lately)\b|\b(?P<other>the other (?:day|night))\b|\b(?P<slash>\d{{1,2}}/\d{{1,2}}/(?:1[89]|20)\d{{2}})\b"
    rf"|\b(?P<later>(?:{_num}) (?:{_units})s? later)\b|\b(?P<vague>for (?:{_num}) (?:{_units})s?|aged \d{{1,3}}|at (?:the )?age (?:of )?\d{{1,3}}|{VAGUE})\b"
    rf"|(?P<iso>\b\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}}(?::\d{{2}})?)?\b)|\b(?P<my>(?:{_month}) (?:1[89]|20)\d{{2}})\b|\b(?P<dm>(?:{_month}) \d{{1,2}},? (?:1[89]|20)\d{{2}})\b"
    rf"|\b(?P<decade>(?:1[89]|20)\d0s)\b|\b(?P<year>(?:1[89]|20)\d{{2}})\b|\b(?P<day>today|yesterday|tomorrow)\b|\b(?P<ago>(?:{_num}) (?:day|week|month|year)s? ago)\b"
    rf"|\b(?P<ahead>in (?:{_num}) (?:day|week|month|year)s?)\b|\b(?P<rel>(?:last|this|next) (?:week|weekend|month|year|{'|'.join(DAYS)}|{'|'.join(SEASONS)}))\b"
    rf"|\b(?P<holiday>(?:{'|'.join(HOLIDAYS)}|thanksgiving|easter)(?: (?:1[89]|20)\d{{2}})?)\b|\b(?P<weekday>{'|'.join(DAYS)})\b|\b(?P<month>{_month})\b",
    re.I,
)


def _day(y, m, d):
    return datetime(y, m, d, tzinfo=UTC)


def add_months(t: datetime, n: int) -> datetime:
    y, m = divmod(t.year * 12 + t.month - 1 + n, 12)
    return t.replace(year=y, month=m + 1, day=min(t.day, calendar.monthrange(y, m + 1)[1]))


def easter(y: int) -> datetime:
    a, b, c = y % 19, y // 100, y % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    n = h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114
    return _day(y, n // 31, n % 31 + 1)


def holiday(name: str, y: int) -> datetime:
    if name == "easter":
        return easter(y)
    if name == "thanksgiving":
        return _day(y, 11, 22 + (3 - _day(y, 11, 22).weekday()) % 7)
    return _day(y, *HOLIDAYS[name])


def _span(kind: str, s: str, now: datetime):
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    one = timedelta(days=1)
    if kind == "iso":
        if len(s) > 10:
            t = datetime.fromisoformat(s.replace(" ", "T")).replace(tzinfo=UTC)
            return t, t, "instant"
        d = datetime.fromisoformat(s).replace(tzinfo=UTC)
        return d, d + one, "day"
    if kind in ("my", "dm"):
        parts = s.replace(",", "").split()
        m, y = MONTHS.index(parts[0]), int(parts[-1])
        if kind == "dm":
            return _day(y, m, int(parts[1])), _day(y, m, int(parts[1])) + one, "day"
        return _day(y, m, 1), add_months(_day(y, m, 1), 1), "month"
    if kind == "decade":
        return _day(int(s[:4]), 1, 1), _day(int(s[:4]) + 10, 1, 1), "decade"
    if kind == "year":
        return _day(int(s), 1, 1), _day(int(s) + 1, 1, 1), "year"
    if kind == "day":
        d = today + one * {"today": 0, "yesterday": -1, "tomorrow": 1}[s]
        return d, d + one, "day"
    if kind == "vague":
        return None, None, "unknown"
    if kind == "slash":  # month first
        m, d, y = (int(x) for x in s.split("/"))
        return _day(y, m, d), _day(y, m, d) + one, "day"
    if kind == "recent":
        return today - 30 * one, today + one, "month"
    if kind == "other":
        return today - 7 * one, today, "week"
    if kind == "few":
        unit, far, near = s.split()[-2].rstrip("s"), *((3, 1) if "couple" in s else (5, 2))
        if unit == "day":
            return today - far * one, today - (0 if "couple" in s else 1) * one, "day"
        if unit == "week":  # the weeks counted, vague by some days on either side
            return today - 7 * far * one, today - (9 if "couple" in s else 13) * one, "week"
        if unit == "month":
            return add_months(today.replace(day=1), -far), add_months(today.replace(day=1), 1 - near), "month"
        return _day(today.year - far, 1, 1), _day(today.year - near + 1, 1, 1), "year"
    if kind in ("thirds", "nth"):
        parts = s.replace("-", " ").split()
        if kind == "thirds" and parts[1].isdigit():
            a, b = {"early": (1, 5), "mid": (5, 9), "late": (9, 13)}[parts[0]]
            return _day(int(parts[1]), a, 1), add_months(_day(int(parts[1]), 1, 1), b - 1), "month"
        month = next(x for x in parts if x in MONTHS[1:])
        start, _, _ = _span("my", f"{month} {parts[-1]}", now) if parts[-1].isdigit() else _span("month", month, now)
        end = add_months(start, 1)
        if kind == "thirds":
            cut = [start, start + 10 * one, start + 20 * one, end]
            k = ("early", "mid", "late").index(parts[0])
            return cut[k], cut[k + 1], "day"
        if parts[0] == "last":
            return end - 7 * one, end, "week"
        first = start + 7 * _ord.index(parts[0]) * one
        return (first, min(first + 7 * one, end), "week") if first < end else (None, None, "unknown")
    if kind == "weekday":
        return _span("rel", "last " + s, now)
    if kind in ("ago", "ahead", "later"):
        parts = s.split()
        word, unit = (parts[1], parts[2]) if kind == "ahead" else (parts[0], parts[1])
        n = 1 if word in ("a", "an") else int(word) if word.isdigit() else WORDS.index(word)
        n, unit = (-n if kind == "ago" else n), unit.rstrip("s")
        if unit == "day":
            return today + one * n, today + one * (n + 1), "day"
        if unit == "week":  # a week off is three days vague on either side
            return today + one * (7 * n - 3), today + one * (7 * n + 4), "week"
        if unit == "month":
            d = add_months(today.replace(day=1), n)
            return d, add_months(d, 1), "month"
        return _day(today.year + n, 1, 1), _day(today.year + n + 1, 1, 1), "year"
    if kind == "rel":
        which, unit = s.split()
        n = {"last": -1, "this": 0, "next": 1}[which]
        monday = today - one * today.weekday()
        if unit == "week":
            return monday + 7 * n * one, monday + 7 * (n + 1) * one, "week"
        if unit == "weekend":
            return monday + (7 * n + 5) * one, monday + (7 * n + 7) * one, "day"
        if unit == "month":
            d = add_months(today.replace(day=1), n)
            return d, add_months(d, 1), "month"
        if unit == "year":
            return _day(today.year + n, 1, 1), _day(today.year + n + 1, 1, 1), "year"
        if unit in DAYS:
            gap = DAYS.index(unit) - today.weekday()
            d = monday + DAYS.index(unit) * one if n == 0 else today + one * ((gap - 1) % 7 + 1 if n > 0 else -((-gap - 1) % 7 + 1))
            return d, d + one, "day"
        year = today.year + n
        d = _day(year, SEASONS[unit], 1)
        return d, add_months(d, 3), "season"
    if kind == "holiday":
        if s[-4:].isdigit():
            d = holiday(s[:-5], int(s[-4:]))
            return d, d + one, "day"
        d = holiday(s, today.year)
        d = d if d <= today else holiday(s, today.year - 1)
        return d, d + one, "day"
    m = MONTHS.index(s)
    y = today.year if m <= today.month else today.year - 1
    return _day(y, m, 1), add_months(_day(y, m, 1), 1), "month"


def _us(t: datetime | None) -> int | None:
    return None if t is None else (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def resolve(text: str | None, anchor_us: int | None) -> list[tuple[str, int | None, int | None, str]]:
    if not text or anchor_us is None:
        return []
    now = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=int(anchor_us))
    found = []  # [from, to, start, end, precision] in the text
    for m in _phrases.finditer(text):
        if m.lastgroup == "month" and not m[0][0].isupper():
            continue  # `may` and `march` as verbs
        try:
            start, end, precision = _span(m.lastgroup, m[0].lower(), now)
        except (ValueError, OverflowError):
            start, end, precision = None, None, "unknown"
        found.append([m.start(), m.end(), start, end, precision])
    out = []
    k = 0
    while k < len(found):
        a, b, start, end, precision = found[k]
        k += 1
        lead = text[max(0, a - 24) : a].lower()
        if start is not None and k < len(found) and found[k][2] is not None and found[k][3] > start:
            between = text[b : found[k][0]].lower()
            if (lead.endswith("from ") and re.fullmatch(r" (?:to|until|till|through) |\s*[-\u2013]\s*", between)) or (lead.endswith("between ") and between == " and "):
                word = "from" if lead.endswith("from ") else "between"
                out.append((text[a - len(word) - 1 : found[k][1]].lower(), _us(start), _us(found[k][3]), min(precision, found[k][4], key=_grade)))
                k += 1
                continue
        shift = _shift.search(lead)
        if shift and start is not None:
            n, unit, way = shift.groups()
            if n or not unit.endswith("s"):
                n = 1 if n in (None, "a", "an", "the") else int(n) if n.isdigit() else WORDS.index(n)
                start, end = _moved(start, end, n, unit.rstrip("s"), way)
                out.append((lead[shift.start() :] + text[a:b].lower(), _us(start), _us(end), unit.rstrip("s")))
                continue
        word = lead.split()[-1] if lead.split() and lead.endswith(" ") else ""
        if start is not None or end is not None:
            if word == "since":
                end = now
            elif word in ("until", "till", "before"):
                start, end = None, start
            elif word == "after":
                start, end = end, None
            elif word == "through":
                start = None
        out.append((text[a:b].lower(), _us(start), _us(end), precision))
    return out


_shift = re.compile(rf"(?:\b({_num}|the) )?\b((?:{_units})s?) (before|after|prior to) $")
_GRADES = ["instant", "day", "week", "month", "season", "year", "decade", "unknown"]


def _grade(precision: str) -> int:
    return _GRADES.index(precision)


def _moved(start: datetime, end: datetime, n: int, unit: str, way: str) -> tuple[datetime, datetime]:
    """The n-th unit before a span starts, or after it ends."""
    sign, base = (1, end) if way == "after" else (-1, start)
    if unit in ("day", "week"):
        step = timedelta(days=7 if unit == "week" else 1)
        return (base + (n - 1) * step, base + n * step) if sign > 0 else (base - n * step, base - (n - 1) * step)
    last = end - timedelta(days=1) if sign > 0 else start
    if unit == "month":
        first = add_months(last.replace(day=1), sign * n)
        return first, add_months(first, 1)
    return _day(last.year + sign * n, 1, 1), _day(last.year + sign * n + 1, 1, 1)


PHRASE = T.StructType([
    T.StructField("phrase", T.StringType()), T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()), T.StructField("precision", T.StringType()),
])


@F.pandas_udf(T.ArrayType(PHRASE))
def time_phrases(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Column function of (text, anchor_us)."""
    names = ("phrase", "start_us", "end_us", "precision")
    for text, anchor in batches:
        yield pd.Series([[dict(zip(names, x)) for x in resolve(t, None if pd.isna(a) else a)] for t, a in zip(text, anchor)])
