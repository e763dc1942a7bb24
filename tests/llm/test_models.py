"""Language ID and the quality classifier: held-out accuracy, and cases at the edges."""

import numpy as np
import pytest

from corpus_jobs.llm import common, language, quality

SMALL = "/root/testdata/sf0.01"


def test_trigrams():
    of, grams = language.trigrams(["Ab", "1 2", "é-x"])
    assert of.tolist() == [0, 0, 2, 2] and len(set(grams.tolist())) == 4


def test_parts_of_long_texts_have_the_same_trigrams():
    for text in ("", "ab", "ab cd, efg h" * 50, "abc" * 40 + " d", "1 2 " * 30, "é-ß " * 20):
        owners, parts = language._parts(["x", text], chars=16)
        assert "".join(parts[1:]) == text and owners.tolist() == [0] + [1] * (len(parts) - 1)
        assert sorted(language.trigrams(parts)[1].tolist()) == sorted(language.trigrams(["x", text])[1].tolist())


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(docs, learn=common.learns("doc_id"))
    rows = language.predict(docs.select("doc_id", "lang", "text"), model).where(~common.learns("doc_id")).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    edge = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 -- 3", "x"), (4, "a", "x"), (5, "the " * 400_000, "x")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(edge, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] in model.languages and got[5] == "en"


def test_filter_has_no_false_negatives_and_corrects_false_positives(spark):
    docs = spark.createDataFrame([(f"l{i:02d}", " ".join(chr(97 + (i * 7 + j * k) % 26) * 2 + chr(97 + (j + i) % 26) for j in range(30) for k in (1, 2))) for i in range(70)], "lang string, text string")
    model = language.fit(docs, bits=12, least_share=0.0)
    assert model.slots.shape == (1 << 12, 2) and len(model.languages) == 70
    rows = docs.collect()
    of, grams = language.trigrams([r["text"] for r in rows])
    at = language._slots(grams, model.hashes, model.bits)
    for k, name in enumerate(model.languages):
        own = of == [r["lang"] for r in rows].index(name)
        bits = [(model.slots[a[own], k // 62] >> np.uint64(k % 62)) & np.uint64(1) for a in at]
        assert np.all(bits)


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame([("abc", None), (None, "en")], "text string, lang string")
    model = language.fit(docs)
    assert [r["lang_pred"] for r in language.predict(docs.select("text"), model).collect()] == ["und", "und"]


def test_held_out_quality(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    measured = quality.with_features(docs)
    model = quality.fit(measured, labels)
    rows = quality.score(measured, model).join(labels, "doc_id").where(~common.learns("doc_id")).collect()
    good = [r["score"] >= 0.3 for r in rows if r["quality"] == 1]
    bad = [r["score"] >= 0.3 for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.3
    one_pass = {r["doc_id"]: r["_s"] for r in quality.score_texts(docs, model, out="_s").collect()}
    assert all(one_pass[r["doc_id"]] == pytest.approx(r["score"]) for r in rows)


def test_tables_and_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_model(x, y, rounds=20)
    assert (0, 1) in {(a, b) for a, b, _ in model.pairs}
    assert np.mean((model.score(rng_x := rng.random((2000, 3))) >= 0.5) == ((rng_x[:, 0] > 0.5) ^ (rng_x[:, 1] > 0.5))) > 0.9


def test_edges_of_the_classifier(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (4, "\n\n \t", "x"), (5, "word " * 300_000, "x")], "doc_id long, text string, features string")
    measured = quality.with_features(docs)
    none = quality.fit(measured, spark.createDataFrame([], "doc_id long, quality int"))
    one = quality.fit(measured, spark.createDataFrame([(1, 1), (2, None), (4, 1)], "doc_id long, quality int"))
    for model in (none, one):
        assert all(0 <= r["score"] <= 1 for r in quality.score(measured, model).collect())
    assert quality.score(measured.where("false"), none).count() == 0
    assert quality.fit_model(np.zeros((0, 16)), np.zeros(0)).score(np.zeros((2, 16))).tolist() == [0.5, 0.5]
