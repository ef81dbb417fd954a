"""Operator 5: forward-backward against enumeration, held-out accuracy, code-switched words, edge cases."""

import itertools
import zlib

import numpy as np

from caseload.llm import language

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    field = language.Field(["a", "b", "c"], np.zeros((4, 3), np.float32))
    field.step = rng.normal(size=(3, 3)).astype(np.float32)
    sizes = [4, 1, 0, 3]
    at = np.cumsum([0, *sizes])
    scores = rng.normal(size=(sum(sizes), 3)).astype(np.float32)
    expected = np.zeros((3, 3), np.float32)
    for got in (field.posteriors(scores.copy(), at), field.posteriors(scores.copy(), at, expected)):
        pairs = np.zeros((3, 3))
        for a, b in zip(at[:-1], at[1:]):
            total, marginal, local = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
            for path in itertools.product(range(3), repeat=b - a):
                weight = np.exp(sum(scores[a + i, y] for i, y in enumerate(path)) + sum(field.step[x, y] for x, y in itertools.pairwise(path)))
                total += weight
                for i, y in enumerate(path):
                    marginal[i, y] += weight
                for x, y in itertools.pairwise(path):
                    local[x, y] += weight
            if b > a:
                assert np.allclose(got[a:b], marginal / total, atol=1e-4)
                pairs += local / total
    assert np.allclose(expected, pairs, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.op5_language(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) >= 0.98


def test_words_of_a_code_switched_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "id")
    field = language.learn(docs, 1000)
    own = {lang: " ".join(r.text for r in docs.where(f"lang = '{lang}'").where(language.held_out(language.F.col("id"))).limit(5).collect()).split()[:120] for lang in ("fr", "de")}
    text = " ".join(own["fr"] + own["de"]).encode()
    words = language.Words()
    data = np.frombuffer(text, np.uint8)
    starts, ends, hashes, at = words.spans(data, np.array([0, len(text)]))
    post = field.posteriors(field.emissions(words, data, starts, ends, hashes), at)
    border = np.searchsorted(starts, len(" ".join(own["fr"]).encode()))
    best = np.array(field.languages)[post.argmax(axis=1)]
    assert (best[:border] == "fr").mean() > 0.9 and (best[border:] == "de").mean() > 0.9


def test_edge_cases(spark, docs_of):
    rows = [(i, "the cat and the dog " * 3) for i in range(30)] + [(100, None), (101, ""), (102, "123 !? —"), (103, "é" * 50_000), (104, "a b " * 30_000), (None, "the dog")]
    got = {r.doc_id: r for r in language.identify(docs_of(rows)).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == got[104].lang_pred == got[None].lang_pred == "en" and got[None].held_out is False
    assert language.identify(docs_of([])).count() == 0
    unknown = docs_of(rows[:5]).withColumn("lang", language.F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unknown).collect()} == {"und"}


def test_rare_languages_are_learned(spark, monkeypatch):
    rows = [(i, f"the cat and dog {i}", "en") for i in range(3000)] + [(5000 + i, "le chat et chien", "fr") for i in range(3)]
    monkeypatch.setattr(language, "fit", lambda samples, languages, lexicon: samples)
    samples = language.learn(spark.createDataFrame(rows, "id long, text string, lang string").repartition(3), 20)
    assert {lang for lang, _ in samples} == {"en", "fr"}
    assert len({tuple(words) for lang, words in samples if lang == "en"}) <= 10
