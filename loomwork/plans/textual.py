"""Registered text, duplicate and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import text
from loomwork.functions.text import MENTION
from loomwork.operators import dedup, retrieval as R
from loomwork.plans.registry import load, query
from loomwork.plans.retrieval import UNITS, tok


@query("exact_duplicates", f"""WITH d AS (SELECT doc_id AS id, array_to_string({tok('text')}, ' ') AS t FROM documents)
SELECT id, min(id) OVER (PARTITION BY t) AS group_id, count(*) OVER (PARTITION BY t) AS n FROM d""")
def exact_duplicates(spark, d):
    return dedup.exact_groups(load(spark, d, "documents"), "doc_id", "text")


NEAR = """(-1, 'One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen'),
(-2, 'one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen.'),
(-3, 'one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen'),
(-4, 'one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen'),
(-5, 'two three four five six seven'), (-6, 'a b'), (-7, 'B A')"""


@query("near_duplicate_links", f"""WITH {UNITS}, a AS (SELECT unit_id AS id, text FROM u UNION ALL SELECT * FROM (VALUES {NEAR}) AS v(id, text)), t AS (SELECT id, {tok('text')} AS w FROM a),
s AS (SELECT id, list_sort(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) ELSE [array_to_string(w, ' ')] END) AS s FROM t WHERE len(w) > 0),
reps AS (SELECT s, min(id) AS id FROM s GROUP BY 1),
x AS (SELECT id, len(s) AS n, unnest(s) AS x FROM reps),
pr AS (SELECT a.id AS a, b.id AS b, count(*)::DOUBLE / (min(a.n) + min(b.n) - count(*)) AS jaccard FROM x a JOIN x b ON a.x = b.x AND a.id <> b.id GROUP BY 1, 2),
k AS (SELECT a, count(*) AS n, round(max(jaccard), 9) AS nearest FROM pr WHERE jaccard >= 0.85 GROUP BY 1)
SELECT s.id, reps.id AS class_id, coalesce(n, 0) AS n_links, nearest FROM s JOIN reps USING (s) LEFT JOIN k ON k.a = reps.id""")
def near_duplicate_links(spark, d):
    """Every unit with the class of its shingle set (its smallest id), the number of other classes it links to, and the nearest of these."""
    units = R.units(load(spark, d, "conversations")).select(F.col("unit_id").alias("id"), "text")
    units = units.unionByName(spark.sql(f"SELECT CAST(id AS BIGINT) AS id, text FROM VALUES {NEAR} AS v(id, text)"))
    links = dedup.near_links(units, "id", "text")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    n = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("jaccard"), 9).alias("nearest"))
    rows = dedup.classes(units, "id", "text").join(n, F.col("class_id") == F.col("a"), "left")
    return rows.select("id", "class_id", F.coalesce("n", F.lit(0)).alias("n_links"), "nearest")


@query("token_estimate", r"""SELECT doc_id, greatest(ceil(octet_length(encode(text)) / 4.0 + len(regexp_extract_all(text, '[.,;:!?]')) * 0.25),
 ceil(len(regexp_extract_all(text, '\S+')) * 0.75))::BIGINT AS tokens FROM documents""")
def token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("sentence_counts", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest FROM s""")
def sentence_counts(spark, d):
    s = load(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    longest = F.coalesce(F.array_max(F.transform("s", F.char_length)), F.lit(0))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), longest.cast("long").alias("longest"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"https?://[A-Za-z0-9./_?=&%#-]+"
IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"


@query("identifier_extraction", f"""WITH x AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '{EMAIL}')) AS surface FROM documents
UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, '{URL}')) FROM documents
UNION ALL SELECT doc_id, 'ip', unnest(regexp_extract_all(text, '{IP}')) FROM documents)
SELECT doc_id, kind, surface, count(*) AS n FROM x GROUP BY ALL""")
def identifier_extraction(spark, d):
    t = load(spark, d, "documents").select("doc_id", "text")
    kinds = [("email", EMAIL), ("url", URL), ("ip", IP)]

    def spans(kind, pattern):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("surface")))

    found = F.flatten(F.array(*[spans(*k) for k in kinds]))
    return t.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*").groupBy("doc_id", "kind", "surface").agg(F.count(F.lit(1)).alias("n"))


@query("redaction", f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g'), '{IP}', '[IP]', 'g')) AS digest FROM documents""")
def redaction(spark, d):
    clean = F.regexp_replace(F.regexp_replace("text", EMAIL, "[EMAIL]"), IP, "[IP]")
    return load(spark, d, "documents").select("doc_id", F.sha2(clean.cast("binary"), 256).alias("digest"))


@query("entity_mentions", f"""WITH {UNITS}, m AS (SELECT unit_id, unnest(regexp_extract_all(text, '{MENTION}')) AS surface FROM u)
SELECT lower(surface) AS canon, count(*) AS mentions, count(DISTINCT unit_id) AS units FROM m GROUP BY 1""")
def entity_mentions(spark, d):
    m = R.units(load(spark, d, "conversations")).select("unit_id", F.explode(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).alias("surface"))
    return m.groupBy(F.lower("surface").alias("canon")).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("unit_id").alias("units"))


@query("substring_lane", """WITH q AS (SELECT item_id, text[11:18] AS needle FROM benchmark WHERE length(text) >= 18)
SELECT item_id, doc_id FROM q JOIN documents ON contains(documents.text, needle)""")
def substring_lane(spark, d):
    """Byte-exact containment of every item's needle of eight characters, as an equi-join on those 8-grams of the documents that may be needles."""
    q = load(spark, d, "benchmark").where("length(text) >= 18").select("item_id", F.substring("text", 11, 8).alias("gram"))
    return dedup.grams_among(load(spark, d, "documents").select("doc_id", "text"), q, 8).join(q, "gram").select("item_id", "doc_id")


@query("benchmark_overlap", f"""WITH b AS (SELECT item_id, {tok('text')} AS w FROM benchmark), bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM b),
n AS (SELECT item_id, count(*) AS total FROM bg GROUP BY 1),
dw AS (SELECT doc_id, {tok('text')} AS w FROM documents), dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM dw WHERE len(w) >= 8)
SELECT doc_id, item_id, count(*) AS shared, round(count(*)::DOUBLE / min(total), 6) AS share FROM dg JOIN bg USING (g) JOIN n USING (item_id) GROUP BY 1, 2""")
def benchmark_overlap(spark, d):
    """Shared 8-word shingles between documents and benchmark items."""
    grams = lambda t, key: load(spark, d, t).select(key, text.tokens(F.col("text")).alias("w")).where(F.size("w") >= 8).select(key, F.explode(text.shingles(F.col("w"), 8)).alias("g"))
    b = grams("benchmark", "item_id")
    total = b.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"))
    hit = grams("documents", "doc_id").join(b, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    return hit.join(total, "item_id").select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("total"), 6).alias("share"))
