"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their base letters.
MARKED = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
WORD = r"[\p{L}\p{N}]+"
MENTION = r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*"


def fold(text: Column) -> Column:
    """Lower-case, with Latin marks removed."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits of the folded text; null gives none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def mentions(text: Column) -> Column:
    """Capitalised names, as written."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))


def shingles(words: Column, k: int) -> Column:
    """Distinct k-word shingles; fewer words give one shingle, none give none."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        one = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.when(F.size(w) >= k, many).otherwise(one))

    # bound once: inside the inner lambda the words would be computed for every shingle
    return F.element_at(F.transform(F.array(words), of), 1)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def token_estimate(text: Column) -> Column:
    """max(ceil(bytes / 4 + punctuation / 4), ceil(0.75 * words))."""
    t = F.coalesce(text, F.lit(""))
    marks = F.size(F.regexp_extract_all(t, F.lit(r"[.,;:!?]"), F.lit(0)))
    words = F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
    return F.greatest(F.ceil(F.octet_length(t) / 4 + marks * 0.25), F.ceil(words * 0.75)).cast("long")


def sentences(text: Column) -> Column:
    """Sentences ended by . ! or ? before white space, or by the text's end."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def digest(text: Column) -> Column:
    """Content address of the folded text with single spaces."""
    return F.sha2(F.array_join(tokens(text), " ").cast("binary"), 256)
