"""Secret scans: fixed patterns plus a randomness test battery, DataFrame only.

Base spans come from three patterns.  The battery looks at the other long
runs of letters, digits and marks.  For each it infers the encoding, and tests under that
alphabet
  * uniformity (chi-squared, Wilson-Hilferty),
  * runs above and below the alphabet's middle (Wald-Wolfowitz),
  * lag-1 serial correlation;
a run that any test rejects (Bonferroni) is structured.  What passes must also
be a discovery: its e-value, the likelihood of a uniform draw over that of
natural characters, grows with its length, and the e-Benjamini-Hochberg rule
holds the false discoveries of each length class below ``fdr``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.scratch import Scratch

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # what AKIA[A-Z0-9]+ finds with 20 characters or more
HEX = r"[0-9a-f]{24,}"  # what [0-9a-f]+ finds with 24 characters or more
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]

# Relative frequencies of a-z in English prose, per cent.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PER_CENT = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074]
# Share of lower-case letters, upper-case letters, digits and marks in natural runs.
SHARES = (0.72, 0.08, 0.15, 0.05)
CAPITALS = 0.05  # share of natural runs that are in capitals, the shares of the cases swapped
# The first that holds the whole run counts, so they go from small to large.
ALPHABETS = [
    ("^[0-9]+$", "0123456789"),
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"),
]
LENGTHS = (32, 48, 96)  # length classes: 20-31, 32-47, 48-95, 96 and more
TOP = 400  # e-values above 10^400 count as 10^400


def _natural(capitals: bool = False) -> list[float]:
    """Log probability of each byte 0..127 in natural runs, or in those in capitals."""
    low, up, digit, mark = SHARES
    low, up = (up, low) if capitals else (low, up)
    total = sum(PER_CENT)
    out = [math.log(1e-6)] * 128
    for c, p in zip(LETTERS, PER_CENT):
        out[ord(c)] = math.log(low * p / total)
        out[ord(c.upper())] = math.log(up * p / total)
    for c in "0123456789":
        out[ord(c)] = math.log(digit / 10)
    for c in "+/_=-":
        out[ord(c)] = math.log(mark / 5)
    return out


def _starts(pieces: Column, found: Column) -> Column:
    """Where each match begins: prefix sums, by chunks so that they stay near linear."""
    step = 256
    both = F.zip_with(pieces, found, lambda p, m: F.coalesce(F.char_length(p), F.lit(0)) + F.coalesce(F.char_length(m), F.lit(0)))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    chunks = lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / step).cast("int")), lambda c: add(F.slice(s, c * step + 1, step)))
    packed = F.struct(both.alias("s"), pieces.alias("p"), found.alias("m"))
    with_chunks = F.transform(F.array(packed), lambda x: F.struct(x["s"].alias("s"), x["p"].alias("p"), x["m"].alias("m"), chunks(x["s"]).alias("c")))

    def places(x):
        return F.transform(
            x["m"],
            lambda _, i: add(F.slice(x["c"], F.lit(1), F.floor(i / step).cast("int")))
            + add(F.slice(x["s"], F.floor(i / step).cast("int") * step + 1, i % step))
            + F.char_length(F.element_at(x["p"], i + 1)),
        )

    return F.flatten(F.transform(with_chunks, places))


SPAN = "array<struct<start:int,kind:int,end:int,token:string>>"


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    starts = _starts(F.split(text, pattern, -1), found)
    spans = F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.char_length(m)).alias("end"), m.alias("token")))
    if keep is not None:
        flags = keep(text)
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("a"), flags.alias("b")), lambda x: x["b"]), lambda x: x["a"])
    return F.when(text.rlike(pattern), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _battery(token: Column) -> Column:
    """struct<ok, loge>: whether the tests pass, and the natural log of the e-value."""
    body = F.regexp_replace(token, "=+$", "")
    body = F.when(body == "", token).otherwise(body)
    alphabet = F.lit(ALPHABETS[-1][1])
    for pattern, chars in reversed(ALPHABETS[:-1]):
        alphabet = F.when(body.rlike(pattern), F.lit(chars)).otherwise(alphabet)
    chars = F.filter(F.split(body, "", -1), lambda c: c != "")
    natural, capitals = (F.array(*[F.lit(x) for x in _natural(c)]) for c in (False, True))
    likelihood = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda a, c: a + F.element_at(of, F.ascii(c) + 1))

    first = F.transform(F.array(F.struct(alphabet.alias("abc"), chars.alias("chars"))), lambda x: F.struct(
        F.char_length(x["abc"]).cast("double").alias("k"),
        F.transform(x["chars"], lambda c: F.position(c, x["abc"]).cast("double") - 1).alias("u"),
        # the likelier of the two, each with its share of natural runs
        F.greatest(likelihood(x["chars"], natural) + math.log(1 - CAPITALS), likelihood(x["chars"], capitals) + math.log(CAPITALS)).alias("nat"),
    ))

    def tests(x):
        k, u, n = x["k"], x["u"], F.size(x["u"]).cast("double")
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, y: a + y)
        squares = total(F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda v: F.pow(F.size(F.filter(u, lambda y: y == v)).cast("double"), 2.0)))
        chi = squares * k / n - n
        df = k - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (df * 9))) / F.sqrt(2 / (df * 9))
        high = total(F.transform(u, lambda y: F.when(y >= k / 2, 1.0).otherwise(0.0)))
        low = n - high
        pairs = F.zip_with(F.slice(u, F.lit(1), F.size(u) - 1), F.slice(u, F.lit(2), F.size(u) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = 1 + total(F.transform(pairs, lambda p: F.when((p["a"] >= k / 2) != (p["b"] >= k / 2), 1.0).otherwise(0.0)))
        mean_runs = 1 + 2 * high * low / n
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        z_runs = F.when(var_runs > 0, F.abs(runs - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(9.0))
        mid = (k - 1) / 2
        var = (k * k - 1) / 12
        corr = total(F.transform(pairs, lambda p: (p["a"] - mid) * (p["b"] - mid))) / (var * n)
        z_corr = F.abs(corr) * F.sqrt(n)
        # normal tails within 2 % of exact; two-sided for runs and correlation
        tail = lambda z: F.exp(-0.717 * F.greatest(z, F.lit(0.0)) - 0.416 * F.pow(F.greatest(z, F.lit(0.0)), 2.0))
        p = 3 * F.least(tail(z_chi) / 2, tail(z_runs), tail(z_corr))
        # the encoding was chosen among the alphabets, hence the last term
        loge = -n * F.log(k) - x["nat"] - math.log(len(ALPHABETS))
        return F.struct((p >= 0.001).alias("ok"), loge.alias("loge"))

    return F.element_at(F.transform(first, tests), 1)


def findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` spans and tested ``candidates`` (start, end, ok, bin, len_class)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    long_enough = lambda t: F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda g: F.char_length(g) >= 6)
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, long_enough), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    out = docs.withColumn("base", base).withColumn("runs", _spans(text, RUN, 3))
    free = F.filter(
        "runs",
        lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])),
    )
    tested = F.transform(free, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), _battery(r["token"]).alias("t")))

    def binned(r):
        n = r["end"] - r["start"]
        cls = sum(((n >= x).cast("int") for x in LENGTHS), F.lit(0))
        e = F.floor(r["t"]["loge"] / math.log(10)).cast("int")
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["t"]["ok"].alias("ok"), F.greatest(F.lit(-1), F.least(F.lit(TOP), e)).alias("bin"), cls.alias("len_class"))

    return out.withColumn("candidates", F.transform(tested, binned)).drop("runs")


def limits(found: DataFrame, fdr: float = 0.01) -> list[int]:
    """Per length class, the smallest log10 e-value that is a discovery (e-BH).

    The driver sees at most 4 * 402 rows of counts over all documents.
    """
    c = found.select(F.explode("candidates").alias("c")).groupBy("c.len_class", "c.bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("c.ok").alias("good")
    )
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in c.collect():
        by.setdefault(r["len_class"], {})[r["bin"]] = (r["n"], r["good"])
    out = []
    for k in range(len(LENGTHS) + 1):
        bins = by.get(k, {})
        tests, hits, least = sum(n for n, _ in bins.values()), 0, TOP + 1
        for b in sorted(bins, reverse=True):
            hits += bins[b][1]
            if b >= 0 and hits and b >= math.log10(tests / (fdr * hits)):
                least = b
        out.append(least)
    return out


def spans(found: DataFrame, least: list[int]) -> DataFrame:
    """``found`` with ``spans``: array of (start, kind, end) by start, then kind."""
    limit = F.array(*[F.lit(x) for x in least])
    added = F.filter("candidates", lambda c: c["ok"] & (c["bin"] >= F.element_at(limit, c["len_class"] + 1)))
    own = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    more = F.transform(added, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return found.withColumn("spans", F.array_sort(F.concat(own, more)))


def label(spans_col: Column) -> Column:
    """kind:start:end, comma-joined; code points, end exclusive."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans_col: Column, mark: str = "[SECRET]") -> Column:
    """Text with every span, or run of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        fresh = s["start"] >= a["at"]
        cut = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, cut).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans_col, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans_col) == 0, text).otherwise(done)


def scan(docs: DataFrame, text_col: str = "text", fdr: float = 0.01) -> DataFrame:
    """``docs`` with base, candidates and spans; texts are read twice.

    Null and empty texts have no spans.  Spans of different kinds may overlap;
    random ones never overlap base ones.  Repeated rows count as separate
    tests.  An empty table gives an empty result.  Columns named base, runs,
    candidates or spans are replaced.
    """
    found = findings(docs, text_col)
    return spans(found, limits(found, fdr))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = Scratch(spark, "secrets").save(findings(docs).drop("text"), "found")
    out = spans(found, limits(found))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(label(base).cast("binary"), 256).alias("base_sha256"), label(F.col("spans")).alias("spans"),
    )
