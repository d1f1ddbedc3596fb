import random

import pytest
import sentencepiece

from loomwork.llm import sentencepiece_trie as st


@pytest.fixture(scope="module")
def own():
    return st.Codec(st.load_vocabulary())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=st.MODEL)


def test_ids_equal_the_library(own, library, spark, sf):
    r = random.Random(1)
    abc = "abcdefghijklmnopqrstuvwxyzéèüßABC.,!?-012 \n\t ▁日本語😀́"
    texts = ["".join(r.choice(abc) for _ in range(r.randrange(0, 60))) for _ in range(1500)]
    texts += ["", " ", "   ", "a\nb  c ", "<s> </s> <unk> <0x0A>", "aaaaaaaaaaaa", "    indented", "x" * 5000, "the the " * 3000, "\n\n\n", "é"]
    texts += [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(t), t[:200]
        if st.SPACE not in t:
            assert own.decode(ids.tolist()) == t


def test_full_cache_changes_nothing(library):
    small = st.Codec(st.load_vocabulary(), most=5)
    texts = ["one two three four five six seven", "eight nine ten one two"]
    for _ in range(4):
        assert [x.tolist() for x in small.encode(texts)] == library.encode(texts)


def test_frames(spark):
    rows = [(1, "Hello wörld", "a"), (2, None, "b"), (3, "", None), (1, "Hello wörld", "a"), (4, "long text " * 20000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {r.doc_id: r for r in st.decode(st.encode(df)).collect()}
    assert {k: r.text for k, r in out.items()} == {r[0]: r[1] for r in rows}
    assert out[2].ids is None and out[3].ids == []
    assert st.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    out = st.op7_sentencepiece(spark, sf).toPandas()
    assert out["round_trip"].all() and (out["n_tokens"] > 0).all()
