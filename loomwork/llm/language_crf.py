"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a posterior over languages by forward-backward, from
affix, character n-gram and lexicon weights and learned transitions; so
code-switched texts are labelled word by word.  A text's language is the one
with the highest mean posterior, its score that mean.

The chain is cut in segments of 32 words.  Segment transfer matrices, then
forward and backward vectors, are computed for all segments of a batch at
once, which is exact and keeps the Python loops short at any text length.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.arrow import bound_batches, slices

BUCKETS = 1 << 16  # hashed n-gram and affix weights
SEGMENT = 32
PIECE = 1 << 20  # characters featurised at a time
_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def _hash(salt: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes[0]), salt, np.uint64)
    for c in codes:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def features(text: str) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Word starts, per-letter slots, per-word slots and word hashes of a text's words.

    Words are the maximal runs of letters of the lower-cased text.
    """
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(_letters()[cp])
    c = cp[at].astype(np.uint64)
    if not len(c):
        e = np.zeros(0, np.int64)
        return e, [e, e], [e, e, e], e.astype(np.uint64)
    first = np.ones(len(c), bool)
    first[1:] = np.diff(at) > 1
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(c)) - 1
    edge = np.uint64(1)  # stands for the word's boundary
    one = np.empty_like(c)
    one[0], one[1:] = edge, c[:-1]
    one[start] = edge
    two = np.empty_like(c)
    two[0], two[1:] = edge, one[:-1]
    two[start] = edge
    grams = [_slot(_hash(11, one, c)), _slot(_hash(12, two, one, c))]
    place = np.arange(len(c)) - np.repeat(start, end - start + 1)
    # a position-dependent sum identifies the word
    whole = np.add.reduceat(_hash(17, c, place.astype(np.uint64)), start)
    third = np.minimum(start + 2, end)
    affixes = [
        _slot(_hash(13, one[end], c[end])),
        _slot(_hash(14, two[end], one[end], c[end])),
        _slot(_hash(15, c[start], c[np.minimum(start + 1, end)], c[third])),
    ]
    return start, grams, affixes, whole


@dataclass
class Model:
    """langs; weights [BUCKETS + words + 1, langs]; transitions; sorted lexicon hashes."""

    langs: list[str]
    weights: np.ndarray
    trans: np.ndarray
    lexicon: np.ndarray

    def lex_slot(self, whole: np.ndarray) -> np.ndarray:
        """Row of a word's lexicon weights; the last row stands for unknown words."""
        if not len(self.lexicon):
            return np.full(len(whole), BUCKETS, np.int64)
        i = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        return BUCKETS + np.where(self.lexicon[i] == whole, i, len(self.lexicon))

    def emissions(self, text: str) -> np.ndarray:
        start, grams, affixes, whole = features(text)
        if not len(start):
            return np.zeros((0, len(self.langs)), np.float32)
        w = self.weights
        out = np.add.reduceat(w[grams[0]] + w[grams[1]], start, axis=0)
        for a in affixes:
            out += w[a]
        return out + w[self.lex_slot(whole)]

    def text_emissions(self, text: str) -> np.ndarray:
        """Emissions of a whole text, piece by piece, cut between words."""
        if len(text) <= PIECE:
            return self.emissions(text)
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
                end += 1
            out.append(self.emissions(text[at:end]))
            at = end
        return np.concatenate(out)


def posteriors(emissions: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Word posteriors [words, langs] of chains laid end to end; with ``pairs``
    also the expected transitions and the log-likelihood normaliser's parts."""
    k = emissions.shape[1]
    words = len(emissions)
    gamma = np.zeros((words, k))
    expected = np.zeros((k, k))
    lengths = np.asarray(lengths)[np.asarray(lengths) > 0]
    if not words:
        return (gamma, expected) if pairs else gamma
    a = np.exp(trans - trans.max())
    psi_all = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64)
    psi_all = np.maximum(psi_all, 1e-30)
    # segments of each chain
    per = -(-lengths // SEGMENT)
    chain = np.repeat(np.arange(len(lengths)), per)
    rank = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    offset = np.repeat(np.cumsum(lengths) - lengths, per) + rank * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(lengths, per) - rank * SEGMENT)
    cell = np.minimum(offset[:, None] + np.arange(SEGMENT), words - 1)
    valid = np.arange(SEGMENT) < size[:, None]
    psi = psi_all[cell]
    s = len(chain)
    # transfer matrices: row = language before the segment, column = at its end
    m = np.broadcast_to(np.eye(k), (s, k, k)).copy()
    if per.max() > 1:
        for t in range(SEGMENT):
            new = (m.reshape(-1, k) @ a).reshape(s, k, k) * psi[:, t, None, :]
            new /= new.max(axis=(1, 2), keepdims=True)
            m = new if valid[:, t].all() else np.where(valid[:, t, None, None], new, m)
    # vectors before the first and after the last word of each segment
    enter, leave = np.ones((s, k)) / k, np.ones((s, k))
    begin = np.cumsum(per) - per
    for r in range(1, int(per.max())):
        live = begin[per > r] + r
        if r == 1:  # the first segment starts without a transition
            alpha = psi[live - 1, 0]
            for t in range(1, SEGMENT):
                alpha = (alpha @ a) * psi[live - 1, t]
                alpha /= alpha.sum(1, keepdims=True)
            enter[live] = alpha
        else:
            v = np.einsum("sk,skl->sl", enter[live - 1], m[live - 1])
            enter[live] = v / v.sum(1, keepdims=True)
    for r in range(int(per.max()) - 1, 0, -1):
        live = begin[per > r] + r
        v = np.einsum("skl,sl->sk", m[live], leave[live])
        leave[live - 1] = v / v.sum(1, keepdims=True)
    alphas = np.empty((SEGMENT, s, k))
    cur = enter
    head = (rank == 0)[:, None]
    for t in range(SEGMENT):
        moved = cur @ a
        if t == 0:
            moved = np.where(head, 1.0, moved)
        new = moved * psi[:, t]
        new /= new.sum(1, keepdims=True)
        cur = np.where(valid[:, t, None], new, cur)
        alphas[t] = cur
    beta = leave
    for t in range(SEGMENT - 1, -1, -1):
        ok = valid[:, t]
        g = alphas[t] * beta
        g /= g.sum(1, keepdims=True)
        gamma[cell[ok, t]] = g[ok]
        back = psi[:, t] * beta
        if pairs:
            prev = alphas[t - 1] if t else enter
            use = ok if t else ok & (rank > 0)
            x = prev[use][:, :, None] * a[None] * back[use][:, None, :]
            expected += (x / x.sum(axis=(1, 2), keepdims=True)).sum(0)
        back = back @ a.T
        back /= back.sum(1, keepdims=True)
        beta = np.where(ok[:, None], back, beta)
    return (gamma, expected) if pairs else gamma


def fit(texts: list[str], labels: list[str], words_in_lexicon: int = 5000, epochs: int = 4, rate: float = 0.4, l2: float = 1e-6, seed: int = 7) -> Model:
    """CRF weights by minibatch Adagrad on the conditional log-likelihood.

    Training chains join segments of different texts, so that transitions
    between languages are seen.
    """
    langs = sorted(set(labels))
    k = len(langs)
    y_of = {x: i for i, x in enumerate(langs)}
    parts = [features(t) for t in texts]
    counts = np.array([len(p[0]) for p in parts])
    if not k or not counts.sum():
        return Model(langs, np.zeros((BUCKETS + 1, max(k, 1)), np.float32), np.zeros((max(k, 1),) * 2), np.zeros(0, np.uint64))
    whole = np.concatenate([p[3] for p in parts])
    found, n = np.unique(whole, return_counts=True)
    keep = np.argsort(-n, kind="stable")[:words_in_lexicon]
    lexicon = np.sort(found[keep[n[keep] > 1]])
    model = Model(langs, np.zeros((BUCKETS + len(lexicon) + 1, k), np.float32), np.zeros((k, k)), lexicon)
    y = np.repeat([y_of[x] for x in labels], counts)
    # per word: list of feature slots, flattened text by text
    slots, sizes = [], []
    for i, p in enumerate(parts):
        m = len(p[0])
        if m:
            size = np.diff(np.append(p[0], len(p[1][0])))
            w = np.repeat(np.arange(m), size)
            rows = np.concatenate([w, w, np.tile(np.arange(m), 4)])
            own = np.concatenate([*p[1], *p[2], model.lex_slot(p[3])]).astype(np.int32)
            slots.append(own[np.argsort(rows, kind="stable")])
            sizes.append(2 * size + 4)
        parts[i] = None
    slots, first = np.concatenate(slots), np.cumsum(np.concatenate([[0], *sizes]))
    # segments of up to 16 words of one text, shuffled into chains of 4
    rng = np.random.default_rng(seed)
    ends = np.cumsum(counts)
    segs = [(lo, min(lo + 16, e)) for c, e in zip(counts, ends) for lo in range(e - c, e, 16)]
    # a language with few words counts for more, up to 50 times
    balance = np.clip(len(y) / (k * np.maximum(np.bincount(y, minlength=k), 1)), 0.02, 50)
    g_w, g_t = np.full(model.weights.shape, 1e-2), np.full((k, k), 1e-2)
    for _ in range(epochs):
        rng.shuffle(segs)
        step = max(64, len(segs) // 12 // 4 * 4)
        for i in range(0, len(segs), step):
            chosen = segs[i : i + step]
            words = np.concatenate([np.arange(a, b) for a, b in chosen])
            lens = np.array([sum(b - a for a, b in chosen[j : j + 4]) for j in range(0, len(chosen), 4)])
            n_f = first[words + 1] - first[words]
            at = np.repeat(first[words] - (np.cumsum(n_f) - n_f), n_f) + np.arange(n_f.sum())
            f = slots[at]
            e = np.add.reduceat(model.weights[f], np.cumsum(n_f) - n_f, axis=0)
            gamma, pair = posteriors(e, lens, model.trans, pairs=True)
            truth = y[words]
            delta = -gamma
            delta[np.arange(len(words)), truth] += 1
            delta *= balance[truth][:, None]
            seen = np.zeros((k, k))
            inner = np.ones(len(words), bool)
            inner[np.cumsum(lens) - lens] = False
            np.add.at(seen, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
            spread = np.repeat(np.arange(len(words)), n_f)
            grad = np.stack([np.bincount(f, delta[spread, j], len(model.weights)) for j in range(k)], axis=1) / len(words)
            grad -= l2 * model.weights
            g_w += grad**2
            model.weights += (rate * grad / np.sqrt(g_w)).astype(np.float32)
            grad_t = (seen - pair) / len(words)
            g_t += grad_t**2
            model.trans += rate * grad_t / np.sqrt(g_t)
    return model


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; `und` and 0 without letters or a model."""
    out, score = ["und"] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return out, score
    e = [model.text_emissions(t) if t else np.zeros((0, len(model.langs)), np.float32) for t in texts]
    n = np.array([len(x) for x in e])
    if not n.sum():
        return out, score
    gamma = posteriors(np.concatenate(e), n, model.trans)
    own = np.flatnonzero(n)
    mean = np.add.reduceat(gamma, (np.cumsum(n) - n)[own], axis=0) / n[own, None]
    best = mean.argmax(1)
    for i, b in zip(own, best):
        out[i] = model.langs[b]
    score[own] = np.clip(mean[np.arange(len(own)), best], 0, 1)
    return out, score


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", each: int = 200, longest: int = 20_000) -> Model:
    """Fit on up to ``each`` labelled texts of every language, however rare it is.

    Rows are drawn by hash.  A text of over ``longest`` characters teaches with
    a piece of that length, from a place drawn by hash.  One task fits on at most
    each * longest characters of a language; the driver gets the weights alone.
    Languages are labels, a few of them.  Null texts teach nothing.
    """
    bound_batches(docs.sparkSession)
    h = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("crf")), 11) / float(1 << 53)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), h.alias("h"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return fit([], [])
    # a rate that leaves each language enough rows, and never all rows of a frequent one in one task
    rates = F.from_json(F.lit(json.dumps({r["lang"]: min(1.0, (each + 6 * math.sqrt(each)) / r["n"]) for r in counts})), "map<string,double>")
    drawn = known.where(F.col("h") < F.element_at(rates, F.col("lang")))
    start = F.floor(F.pmod(F.col("h") * 1e6, F.lit(1.0)) * F.greatest(F.char_length("text") - longest, F.lit(0))) + 1
    drawn = drawn.select(F.substring("text", start.cast("int"), F.lit(longest)).alias("text"), "lang", "h")
    order = W.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    rows = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each)
    rows = rows.repartition(1).sortWithinPartitions("h", "lang", F.xxhash64("text")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            labels += b.column("lang").to_pylist()
        if texts:
            m = fit(texts, labels)
            cols = [pa.array([m.langs], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in (m.weights, m.trans, m.lexicon))]
            yield pa.RecordBatch.from_arrays(cols, names=["langs", "weights", "trans", "lexicon"])

    found = rows.mapInArrow(run, "langs array<string>, weights binary, trans binary, lexicon binary").collect()
    if not found:
        return fit([], [])
    langs, *made = found[0]
    weights, trans, lexicon = (np.frombuffer(bytes(x), kind) for x, kind in zip(made, (np.float32, np.float64, np.uint64)))
    return Model(langs, weights.reshape(-1, len(langs)), trans.reshape(len(langs), -1), lexicon)


def label(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with lang_pred and lang_score, or as ``pred_col`` and ``score_col`` say.

    A null text, or one without a letter, is `und` with score 0, and so is all
    if nothing was learned.  Every word of a text counts, however long it is.
    Repeated rows and extra columns pass through; columns named like
    the two are replaced.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS + lexicon rows
    src = docs.drop(pred_col, score_col)
    at = src.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.schema.names[at] != text_col:
                raise AssertionError("columns moved")
            for c in slices(iter([b]), text_col, 2 << 20):
                lang, score = predict(shared.value, c.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*c.schema.names, pred_col, score_col])

    fields = [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    return src.mapInArrow(run, T.StructType([*src.schema.fields, *fields]))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op2_language_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~F.coalesce(held_out(), F.lit(False))))
    out = label(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
