import random
import re

import sentencepiece

import corpus_pipeline
from loomwork.llm import sentencepiece_trie
from tests.llm.test_simhash_sets import components


def docs_table(spark, path):
    r = random.Random(4)
    en = "the house of a man and his dog is on the hill with an old tree".split()
    fr = "la maison de un homme et son chien est sur une colline avec le vieux arbre".split()
    rows = []
    for i in range(160):
        words = [r.choice(en if i % 2 else fr) for _ in range(r.randrange(30, 90))]
        rows.append((i, " ".join(words), "en" if i % 2 else "fr", f"src{0 if i % 3 == 0 else i % 7}"))
    rows += [(200 + i, rows[5][1], "en", "src0") for i in range(40)]
    rows += [(300, rows[8][1] + " password=hunter2222", "fr", "src1"), (301, "12345 --- ###", None, "src1"), (302, None, None, None), (303, "", "en", "src2")]
    rows += [(304, "mon token: abcdef123456 est la", "fr", None)] + [(304, "mon token: abcdef123456 est la", "fr", None)]
    df = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return {x[0]: x[1] for x in rows}


def test_equals_brute_force(spark, tmp_path):
    texts = docs_table(spark, str(tmp_path))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    lettered = {i: t for i, t in sorted(texts.items()) if t and re.search("[^\\W\\d_]", t)}
    ids = list(lettered)
    comp = components([lettered[i] for i in ids])
    kept = {ids[k] for k in range(len(ids)) if comp[k] == k}
    assert set(got) == kept
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_trie.MODEL)
    for i in kept:
        clean = re.sub(r"(?i:password|token)\s*[:=]\s*[A-Za-z0-9]+", "[SECRET]", lettered[i])
        assert got[i] == sp.encode(clean), lettered[i]


def test_stages_keep_columns_and_order(spark, tmp_path):
    docs_table(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "redact_secrets", "mix_sources", "tokenize"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        if name == "mix_sources":
            first = [r.source for r in out.limit(80).collect()]  # ten blocks of eight
            assert len(set(first)) >= 5  # mixed, not in blocks by source
        path = f"{tmp_path}/{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    masked = docs.where("text like '%[SECRET]%'").collect()
    assert masked and all(r.n_chars == len(r.text) for r in masked)


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_come_through_unchanged(spark, tmp_path):
    names = "lang_pred string, LANG_SCORE double, runs int, spans int, base int, candidates int, mix_slot int, mix_position int, h int, g int, th string, id int, ids int, text_hash int, row int, source_text string"
    rows = [(i, f"le chat est sur la table numero {i} password=hunter{i}xx de la maison" + " bleue" * i, "fr", f"s{i % 2}", 9, "p", 0.5, 1, 2, 3, 4, 5, 6, 7, 8, "t", 9, 10, 11, 12, "u") for i in range(20)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars int, {names}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        got = {tuple(r)[5:] for r in out.collect()}
        assert got == {rows[0][5:]}, name
    assert corpus_pipeline.tokenize(spark, docs, "").count() == 20


def test_equal_ids_with_different_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(3, a), (5, b), (5, a), (5, b), (None, a), (7, None), (8, "")], "doc_id long, text string")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(0, a), (3, a), (5, b), (7, "")])


def test_very_long_text(spark):
    long = "le chat est dans la maison " * 60_000
    docs = spark.createDataFrame([(1, long, "fr", "s", len(long)), (2, "le chat noir est dans la rue", "fr", None, 28), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert {r.doc_id: r.n_tokens > 100_000 for r in docs.collect()} == {1: True, 2: False}


def test_run_returns_the_interleaving(spark, tmp_path):
    docs_table(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = sorted(out.select("source", "mix_slot", "mix_position").collect(), key=lambda r: r.mix_position)
    assert len({r.mix_position for r in rows}) == len(rows)
    assert all(r.mix_position // 8 == r.mix_slot for r in rows)
    # a slot holds one source, and every source has a slot among the first ten
    slots = {}
    for r in rows:
        slots.setdefault(r.mix_slot, set()).add(r.source)
    assert all(len(s) == 1 for s in slots.values())
    assert sorted(slots) == list(range(len(slots)))
    assert set().union(*[slots[t] for t in range(10)]) >= {f"src{k}" for k in range(7)} & {r.source for r in docs.collect()}
