"""Feature-hashing text encoder: 384 dimensions of words and character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS, WORD, GRAM = 384, 1.0, 0.6  # fixed values
_words = re.compile(r"[^\W_]+")


@lru_cache(100_000)
def _parts(word: str) -> tuple[tuple[int, float, float], ...]:
    """(dimension, sign, weight) of a word and its bounded 3- to 5-grams."""
    edged = f"<{word}>"
    grams = [(word, WORD)] + [(edged[i : i + n], GRAM) for n in (3, 4, 5) for i in range(len(edged) - n + 1)]
    out = []
    for g, w in grams:
        h = xxhash.xxh64_intdigest(f"{w}:{g}")
        out.append((h % DIMS, 1.0 if h >> 63 else -1.0, w))
    return tuple(out)


def encode(text: str | None) -> np.ndarray:
    """Unit vector; all zero for a text without words."""
    v = np.zeros(DIMS)
    for word, n in Counter(_words.findall((text or "").casefold())).items():
        for d, sign, w in _parts(word):
            v[d] += sign * np.log1p(n * w)
    norm = np.linalg.norm(v)
    return v / norm if norm else v


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([encode(t).astype(np.float32) for t in texts])
