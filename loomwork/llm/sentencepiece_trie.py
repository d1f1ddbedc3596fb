"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The vocabulary is a BPE one, for which a plain maximum-score Viterbi gives
other ids than SentencePiece.  The forward pass therefore keeps, for every
prefix, the last piece of the prefix's own segmentation: a piece may follow
another only if merging the two alone leaves both as they are, and exactly one
path through each prefix meets that at every joint.  That makes forward states
a function of the prefix, so sorted distinct words are walked as a trie,
depth first, and a common prefix is computed once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.arrow import bound_batches, fresh_names, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def load_vocabulary(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id, read on the driver; a model is some 500 KB."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("a BPE model with identity normalisation, dummy prefix and kept white space is needed")
    out = [(p.piece, p.score, p.type) for p in model.pieces]
    if any(t == NORMAL and SPACE in p.lstrip(SPACE) for p, _, t in out):
        raise ValueError("pieces must not join words")
    return out


class Codec:
    """Encoder and decoder for one vocabulary; caches at most ``most`` words."""

    def __init__(self, vocabulary: list[tuple[str, float, int]], most: int = 500_000):
        self.ids = {p: i for i, (p, _, t) in enumerate(vocabulary) if t == NORMAL}
        self.score = [s for _, s, _ in vocabulary]
        self.piece = [p for p, _, _ in vocabulary]
        # lengths of the pieces with each last three characters, longest first
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                lengths.setdefault(p[-3:], {2, 1}).add(len(p))
        self.tail = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(vocabulary) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(vocabulary) if t == UNKNOWN), 0)
        self.raw = [
            bytes.fromhex(p[3:5]) if t == BYTE else b"" if t == 3 else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, t in vocabulary
        ]
        known = "".join(re.escape(p) for p in self.ids if len(p) == 1)
        self.foreign = re.compile(f"[^{known}]")
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.joint: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.missed: set[int] = set()
        self.most = most

    def merge(self, word: str) -> list[int]:
        """BPE by its definition: the best-scored adjacent pair first, leftmost on ties."""
        parts, ids, score = list(word), self.ids, self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                t = ids.get(parts[i] + parts[i + 1])
                if t is not None and (best is None or score[t] > best):
                    best, at = score[t], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids[p] for p in parts]

    def _joins(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.joint.get(key)
        if ok is None:
            if len(self.joint) > 2_000_000:
                self.joint.clear()
            ok = self.joint[key] = self.merge(self.piece[a] + self.piece[b]) == [a, b]
        return ok

    def segment(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words of known characters, sharing prefixes."""
        out: dict[str, list[int]] = {}
        last: list[int] = [-1]  # last[i]: last piece of the current word's first i characters
        before = ""
        ids, tail, piece, joint = self.ids.get, self.tail.get, self.piece, self.joint.get
        short = (2, 1)
        for w in sorted(words):
            n = min(len(w), len(before))
            i = 0
            while i < n and w[i] == before[i]:
                i += 1
            del last[i + 1 :]
            for end in range(i + 1, len(w) + 1):
                found = -1
                for size in tail(w[end - 3 : end], short) if end > 2 else short:
                    start = end - size
                    if start < 0:
                        continue
                    t = ids(w[start:end])
                    if t is None:
                        continue
                    if start:
                        ok = joint(last[start] << 20 | t)
                        if not (self._joins(last[start], t) if ok is None else ok):
                            continue
                    found = t
                    break
                if found < 0:
                    raise AssertionError(f"no segmentation of {w[:end]!r}")
                last.append(found)
            path, end = [], len(w)
            while end:
                path.append(last[end])
                end -= len(piece[last[end]])
            path.reverse()
            out[w] = path
            before = w
        return out

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Little-endian int32 ids of each marked word."""
        parts: dict[str, list[str]] = {}
        plain: set[str] = set()
        for w in words:
            if self.foreign.search(w):
                parts[w] = self._split(w)
                plain.update(x for x in parts[w] if not self.foreign.match(x))
            else:
                plain.add(w)
        done = self.segment(list(plain))
        out = {w: array("i", done[w]).tobytes() for w in plain if w not in parts}
        for w, xs in parts.items():
            ids: list[int] = []
            for x in xs:
                ids += done[x] if x in done else [self.byte.get(b, self.unknown) for b in x.encode("utf-8", "surrogatepass")]
            out[w] = array("i", ids).tobytes()
        return out

    def _split(self, word: str) -> list[str]:
        out, at = [], 0
        for m in self.foreign.finditer(word):
            out += [word[at : m.start()]] * (m.start() > at) + [m[0]]
            at = m.end()
        return out + [word[at:]] * (at < len(word))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        cache = self.cache
        fresh = {w for ws in split for w in ws if w not in cache}
        more = self.encode_words(fresh)
        # past a third of the room a word is kept once it is missed a second time; most are rare
        early = len(cache) < self.most // 3
        for w in [w for w in more if early or hash(w) in self.missed][: max(0, self.most - len(cache))]:
            cache[w] = more.pop(w)
        if len(self.missed) > 1_000_000:
            self.missed.clear()
        self.missed.update(map(hash, more))
        if more:
            return [np.frombuffer(b"".join([cache[w] if w in cache else more[w] for w in ws]), "<i4") for ws in split]
        return [np.frombuffer(b"".join([cache[w] for w in ws]), "<i4") for ws in split]

    def decode(self, ids: Iterable[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each Python worker and broadcast vocabulary."""
    if shared.value[0] not in _codecs:
        _codecs.clear()
        _codecs[shared.value[0]] = Codec(shared.value[1])
    return _codecs[shared.value[0]]


def _share(spark, path):
    vocabulary = load_vocabulary(path)
    return spark.sparkContext.broadcast((hash((path, len(vocabulary))), vocabulary))


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", model: str = MODEL, check_col: str = "") -> DataFrame:
    """``docs`` without the text, plus ``out_col``: array<int> of piece ids.

    The ids equal SentencePiece's own for the model.  A null text gives null, an
    empty one no ids; characters outside the vocabulary become byte pieces.
    Repeated rows and extra columns pass through; an extra column named like
    ``out_col`` is replaced.  An empty table gives an empty result.  With
    ``check_col``, a boolean says whether decoding the ids gives the text back
    (null for a null text); a text that itself holds U+2581 does not.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = _share(spark, model)
    keep = [c for c in docs.columns if c not in (text_col, out_col, check_col)]
    (hidden,) = fresh_names(keep, "source_text")
    src = docs.select(*keep, F.col(text_col).cast("string").alias(hidden))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in slices(batches, hidden, 4 << 20):
            texts = b.column(hidden).to_pylist()
            ids = codec.encode(texts)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            null = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), mask=null)
            more = [pa.array([None if t is None else codec.decode(x.tolist()) == t for t, x in zip(texts, ids)], pa.bool_())] if check_col else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists, *more], names=names)

    names = [*keep, out_col, *[check_col] * bool(check_col)]
    added = [T.StructField(out_col, T.ArrayType(T.IntegerType())), *[T.StructField(check_col, T.BooleanType())] * bool(check_col)]
    schema = T.StructType([*src.drop(hidden).schema.fields, *added])
    return src.mapInArrow(run, schema)


def decode(tokens: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """``tokens`` plus ``out_col``: the decoded text; a null list gives null."""
    spark = tokens.sparkSession
    bound_batches(spark)
    shared = _share(spark, model)
    src = tokens.drop(out_col)
    at = src.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            ids = b.column(at)
            values, offsets = ids.values.to_pylist(), ids.offsets.to_pylist()
            null = pa.compute.is_null(ids).to_pylist()
            texts = [None if n else codec.decode(values[i:j]) for n, i, j in zip(null, offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out_col, T.StringType())]))


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, check_col="round_trip")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
