"""The stages one by one against what plain Python says of their own input."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from corpus_jobs.llm import common, packing
from plain import smallest_ids

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.materialise(stage(spark, out[-1], SMALL), name))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality_keeps_labelled_good_documents(spark, steps):
    kept = rows(steps[1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.4 * sum(q == 0 for q in labels.values())
    before = rows(steps[0])
    assert all(before[i] == r for i, r in kept.items())


def test_copies_go(steps):
    before, exact, near = rows(steps[1]), rows(steps[2]), rows(steps[3])
    key = {i: re.sub(r"[ \t-\r]", "", r["text"]) for i, r in before.items()}
    assert len(exact) == len(set(key.values())) and set(key[i] for i in exact) == set(key.values())
    best = {k: min(i for i, v in key.items() if v == k and len(before[i]["text"]) == max(len(before[j]["text"]) for j, w in key.items() if w == k)) for k in set(key.values())}
    assert set(exact) == set(best.values())
    assert set(near) == smallest_ids({i: r["text"] for i, r in exact.items()})


def test_secrets_are_masked_and_documents_stay(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert before.keys() == after.keys()
    pattern = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}""", re.I)
    for i, r in after.items():
        assert not re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", r["text"]) and r["n_chars"] == len(r["text"])
        assert (r["text"] == before[i]["text"]) or "[SECRET]" in r["text"]
        assert pattern.search(before[i]["text"]) is None or "[SECRET]" in r["text"]


def test_packing_holds_every_document(steps):
    out = steps[5].collect()
    assert {r["doc_id"] for r in out} == set(rows(steps[4]))
    used = Counter()
    for r in out:
        used[r["sequence_id"]] += r["length"]
    total = sum(used.values())
    assert max(used.values()) <= 2048 and len(used) <= -(-total // 2048) * 1.05 + 1
    histogram = Counter(r["length"] for r in out)
    assert packing.plan(dict(histogram), 2048)[1] == len(used)


def test_edges_of_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns pass; an empty table stays empty."""
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", None, "s", 0), (2, "word " * 60_000, "en", None, 300_000), (3, "token=abcdefgh1 clean words", "en", "s", 27), (3, "token=abcdefgh1 clean words", "en", "s", 27), (4, "x", "en", "s", 1)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clashes = ["_locator", "_score", "features", "score", "_findings", "digest", "fp", "first", "n", "kept", "_text", "chars", "root", "length"]
    plain = spark.createDataFrame(rows, fields)
    wide = plain.selectExpr("*", *(f"'{c}' AS `{c}`" for c in clashes))
    sizes = {"quality": [6], "exact_dedup": [4], "near_dedup": [3, 4], "secrets": [3, 4]}
    for start in (plain, wide, plain.where("false")):
        docs = common.materialise(start, "start")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialise(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == start.columns
            assert docs.count() in ([0] if start.isEmpty() else sizes[name])
            assert all(r[c] == c for r in docs.collect() for c in start.columns[5:])
        assert {r["text"] for r in docs.where("doc_id = 3").collect()} == (set() if start.isEmpty() else {"[SECRET] clean words"})
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == docs.count()


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SMALL).count() == steps[5].count()
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
