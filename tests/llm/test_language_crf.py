import itertools
import os
import random

import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import language_crf as crf


def slow_posteriors(e, trans):
    n, k = e.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        s = sum(e[t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
        for t, y in enumerate(path):
            out[t, y] += np.exp(s)
    return out / out.sum(1, keepdims=True)


def test_forward_backward_is_exact(monkeypatch):
    monkeypatch.setattr(crf, "SEGMENT", 3)
    rng = np.random.default_rng(0)
    trans = rng.normal(size=(3, 3))
    lens = [1, 7, 3, 0, 6, 8]
    e = rng.normal(size=(sum(lens), 3)) * 2
    got = crf.posteriors(e, lens, trans)
    at = 0
    for n in lens:
        if n:
            assert np.allclose(got[at : at + n], slow_posteriors(e[at : at + n], trans))
        at += n


def test_expected_transitions(monkeypatch):
    monkeypatch.setattr(crf, "SEGMENT", 2)
    rng = np.random.default_rng(1)
    trans, e = rng.normal(size=(2, 2)), rng.normal(size=(5, 2))
    _, pair = crf.posteriors(e, [5], trans, pairs=True)
    want, z = np.zeros((2, 2)), 0.0
    for p in itertools.product(range(2), repeat=5):
        s = np.exp(sum(e[t, y] for t, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])))
        z += s
        for a, b in zip(p, p[1:]):
            want[a, b] += s
    assert np.allclose(pair, want / z)


def test_code_switched_words():
    texts = ["the house of the man and the dog"] * 20 + ["la maison de la femme et le chien"] * 20
    m = crf.fit(texts, ["en"] * 20 + ["fr"] * 20)
    t = "the man and the dog la femme et le chien"
    g = crf.posteriors(m.text_emissions(t), [10], m.trans)
    assert (g[:5, 0] > 0.5).all() and (g[5:, 1] > 0.5).all()


def test_defined_results(spark):
    rows = [(1, "the cat", "en", 9.0), (2, None, "en", None), (3, "", None, 1.0), (4, "12 -- ##", "fr", 1.0), (5, "mot " * 300000, "fr", 2.0), (1, "the cat", "en", 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score double")
    out = crf.label(df, crf.learn(df)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 6 and by[1].lang_pred == "en" and 0 < by[1].lang_score <= 1
    assert all(by[i].lang_pred == "und" and by[i].lang_score == 0 for i in (2, 3, 4))
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert crf.label(empty, crf.learn(empty)).count() == 0
    assert {r.lang_pred for r in crf.label(df, crf.learn(empty)).collect()} == {"und"}


def test_pieces_agree_with_whole(monkeypatch):
    m = crf.fit(["alpha beta gamma"] * 3 + ["uno dos tres"] * 3, ["a"] * 3 + ["b"] * 3)
    t = "alpha, dos beta-tres " * 40
    whole = m.text_emissions(t)
    monkeypatch.setattr(crf, "PIECE", 17)
    assert np.allclose(m.text_emissions(t), whole)


def test_held_out_accuracy(spark):
    out = crf.op2_language_crf(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    out = out.merge(docs, on="doc_id")
    assert len(out) == len(docs)
    own = out[out.held_out]
    assert 0.15 < len(own) / len(out) < 0.35
    assert (own.lang_pred == own.lang).mean() > 0.97


def test_rare_languages_and_long_texts_are_learned(spark):
    r = random.Random(2)
    vocab = {"en": "the house of man and dog is on hill with old tree".split(), "fi": "talo on vanha ja koira istuu puun alla metsassa".split(), "pl": "dom jest stary a pies siedzi pod drzewem lesie".split()}
    make = lambda k, n: " ".join(r.choice(vocab[k]) for _ in range(n))
    rows = [(i, make("en", 12), "en") for i in range(3000)] + [(5000 + i, make("fi", 12), "fi") for i in range(8)]
    rows += [(6000 + i, make("pl", 5000), "pl") for i in range(2)] + [(None, None, "xx"), (7000, "x", None)]
    model = crf.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fi", "pl"]
    langs, _ = crf.predict(model, [make("fi", 15), make("pl", 15), make("en", 15)])
    assert langs == ["fi", "pl", "en"]


def test_a_task_fits_and_the_driver_gets_the_weights(spark, sf, monkeypatch):
    fit, driver = crf.fit, os.getpid()

    def elsewhere(texts, labels):
        assert os.getpid() != driver or not texts
        return fit(texts, labels)

    df = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text is not null")
    rows = df.select("text", "lang", F.xxhash64("doc_id", "text", F.lit("crf")).alias("h")).collect()
    rows.sort(key=lambda r: r.h % (1 << 64) >> 11)
    want = fit([r.text for r in rows], [r.lang for r in rows])
    monkeypatch.setattr(crf, "fit", elsewhere)
    got = crf.learn(df, each=len(rows), longest=1 << 20)
    assert got.langs == want.langs and (got.weights == want.weights).all() and (got.trans == want.trans).all() and (got.lexicon == want.lexicon).all()
    assert crf.learn(df.where("false")).langs == []
