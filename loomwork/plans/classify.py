"""Registered text classifiers, guards, spans and normal forms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import markers
from loomwork.operators import retrieval as R
from loomwork.plans.registry import load, query
from loomwork.plans.retrieval import UNITS

# RE2 has no look-around: an outer character stands for it, and "manages to" is taken out beforehand
PLAIN_QUOTE = markers.QUOTE_PAIR.replace(r"(?<![\w'])", r"(?:^|[^\w'])").replace(r"(?![\w'])", r"(?:$|[^\w'])")


def _sql(rules, rest: str, swap=lambda p: p) -> str:
    whens = "".join(f" WHEN regexp_matches(t, '(?i)(?:{swap(p)})'::VARCHAR) THEN '{n}'" for n, p in ((n, p.replace("'", "''")) for n, p in rules))
    return f"CASE{whens} ELSE '{rest}' END"


POLARITY = _sql([(n, p.replace(markers.QUOTE_PAIR, PLAIN_QUOTE)) for n, p in markers.POLARITY], "affirmative")
TYPE = _sql([(n, p.replace(r"(?!\s+to\b)", "")) for n, p in markers.TYPES.items()], "untyped").replace(
    "WHEN regexp_matches(t, '(?i)(?:\\b(?:works?", "WHEN regexp_matches(regexp_replace(t, '(?i)\\b(manages|leads)\\s+to\\b', ' ', 'g'), '(?i)(?:\\b(?:works?"
)


@query("polarity", f"WITH {UNITS} SELECT unit_id, {POLARITY} AS polarity FROM (SELECT unit_id, coalesce(text, '') AS t FROM u)")
def polarity(spark, d):
    return R.units(load(spark, d, "conversations")).select("unit_id", markers.polarity(F.col("text")).alias("polarity"))


@query("memory_type", f"WITH {UNITS} SELECT unit_id, {TYPE} AS kind FROM (SELECT unit_id, coalesce(text, '') AS t FROM u)")
def memory_type(spark, d):
    return R.units(load(spark, d, "conversations")).select("unit_id", markers.memory_type(F.col("text")).alias("kind"))


@query("duplicate_guards", f"""WITH {UNITS}, n AS (SELECT unit_id, session_id, seq, {POLARITY} AS p, {TYPE} AS k, list_sort(list_distinct(regexp_extract_all(t, '\\d+(?:\\.\\d+)?'))) AS n FROM (SELECT *, coalesce(text, '') AS t FROM u)),
l AS (SELECT unit_id, p, k, n, lag(unit_id) OVER w AS prior, lag(p) OVER w AS pp, lag(k) OVER w AS pk, lag(n) OVER w AS pn FROM n WINDOW w AS (PARTITION BY session_id ORDER BY seq, unit_id))
SELECT unit_id, prior, p = pp AND k = pk AND n = pn AS may_link FROM l WHERE prior IS NOT NULL""")
def duplicate_guards(spark, d):
    """Whether each turn may be linked with the one before: polarity, type and numbers must agree."""
    w = W.partitionBy("session_id").orderBy(F.asc_nulls_last("seq"), F.asc_nulls_last("unit_id"))
    u = R.units(load(spark, d, "conversations")).select("unit_id", "session_id", "seq", "text")
    p = u.withColumn("prior", F.lag("unit_id").over(w)).withColumn("before", F.coalesce(F.lag("text").over(w), F.lit(""))).where("prior is not null")
    return p.select("unit_id", "prior", markers.same_guards(F.col("text"), F.col("before")).alias("may_link"))


SENT = r"[^.!?]+[.!?]*"


@query("sentence_windows", f"""WITH {UNITS}, s AS (SELECT unit_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{SENT}'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM u)
SELECT unit_id, k AS part, array_to_string(s[k * 3 + 1:k * 3 + 3], ' ') AS part_text FROM (SELECT unit_id, s, unnest(range(0, (len(s) + 2) // 3)) AS k FROM s WHERE len(s) > 3)""")
def sentence_windows(spark, d):
    """Turns of more than three sentences cut in disjoint windows of three."""
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SENT), F.lit(0)), lambda x: F.trim(x))
    u = R.units(load(spark, d, "conversations")).select("unit_id", F.filter(found, lambda x: x != "").alias("s")).where(F.size("s") > 3)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / 3)), lambda k: F.struct(k.cast("long").alias("part"), F.array_join(F.slice("s", (k * 3 + 1).cast("int"), F.lit(3)), " ").alias("part_text")))
    return u.select("unit_id", F.explode(parts).alias("p")).select("unit_id", "p.*")


@query("line_spans", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, l, unnest(range(0, len(l))) AS line FROM l),
k AS (SELECT doc_id, line, trim(l[line + 1], ' ') AS t FROM i)
SELECT doc_id, line, CASE WHEN regexp_matches(t, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(t, '^([-*+]|[0-9]+[.)]) ') THEN 'list' WHEN regexp_matches(t, '^\\|.*\\|$') THEN 'table' ELSE 'text' END AS form, length(t) AS chars FROM k WHERE length(t) >= 12""")
def line_spans(spark, d):
    """Candidate spans of each document: its lines of twelve characters and more, with their form."""
    docs = load(spark, d, "documents").where("text is not null")
    k = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t")).select("doc_id", F.col("line").cast("long").alias("line"), F.trim("t").alias("t"))
    form = F.when(F.col("t").rlike("^#{1,6} "), "heading").when(F.col("t").rlike(r"^([-*+]|[0-9]+[.)]) "), "list").when(F.col("t").rlike(r"^\|.*\|$"), "table").otherwise("text")
    return k.where(F.length("t") >= 12).select("doc_id", "line", form.alias("form"), F.length("t").cast("long").alias("chars"))


@query("utf8_spans", """WITH b AS (SELECT doc_id, text, strlen(text[1:10]) AS byte_start, strlen(text[1:40]) AS byte_end FROM documents WHERE text IS NOT NULL)
SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, byte_start, byte_end, text[11:40] AS quote FROM b""")
def utf8_spans(spark, d):
    """A byte-range quote of every document: characters 11 to 40 by their byte offsets, cut from the encoded text."""
    docs = load(spark, d, "documents").where("text is not null")
    size = lambda n: F.octet_length(F.substring("text", 1, n)).cast("long")
    b = docs.select("doc_id", "text", size(10).alias("byte_start"), size(40).alias("byte_end"))
    quote = F.decode(F.expr("substring(encode(text, 'UTF-8'), cast(byte_start as int) + 1, cast(byte_end - byte_start as int))"), "UTF-8")
    return b.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"), "byte_start", "byte_end", quote.alias("quote"))


@query("normalised_digest", """SELECT sha256(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' ')) AS digest, count(*) AS docs, min(doc_id) AS first FROM documents GROUP BY 1""")
def normalised_digest(spark, d):
    """Documents equal up to case, marks and spacing share a digest."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))
    g = load(spark, d, "documents").groupBy(F.sha2(norm.cast("binary"), 256).alias("digest"))
    return g.agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"))
