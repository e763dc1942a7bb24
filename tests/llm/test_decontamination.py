import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_jobs.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, span=10):
    """(words, spans hit, ids of items) of every text."""
    windows = {}
    for item, text in items:
        ws = plain_words(text)
        n = min(span, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for text in docs:
        ws, hit, found = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if of := windows.get(tuple(ws[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= of
        out.append((len(ws), len(hit), sorted(found)))
    return out


def measured(spark, docs, items, **more):
    rows = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(docs)], "doc_id long, text string, spans string, _locator array<int>")
    known = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, window int")
    found = {r["doc_id"]: r for r in decontamination.contamination(rows, known, **more).collect()}
    return [(found[i]["n_words"], sum(s["end"] - s["start"] for s in found[i]["spans"]), found[i]["items"]) for i in range(len(docs))]


DOCS = ["The quick Brown fox", "The quick Brown fox", None, "", " \n\x00", "... the quick, brown fox JUMPS over the lazy dog again and again and again, isn't it; ÉÀ é", "x " * 5000 + "the quick brown fox " * 300, "a b a b a b a b a b a b a b"]
ITEMS = [(1, "quick BROWN"), (2, None), (3, "!!"), (None, "over the lazy dog again and again"), (10, "brown fox jumps over the lazy dog again and again and again isn t it"), (9, "brown fox jumps over the lazy dog again and again and again isn t it"), (10, "ÉÀ"), (4, "b a b a b a b a b a b"), (1, "quick BROWN")]


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_spans_and_items_of_odd_texts(spark, broadcast_bytes):
    assert measured(spark, DOCS, ITEMS, broadcast_bytes=broadcast_bytes) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    assert measured(spark, DOCS, []) == brute(DOCS, [])
    assert measured(spark, [], ITEMS) == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=14), st.integers(1, 12))
def test_every_shared_span_keeps_a_hash(spark_rows, text, item, span):
    n = min(span, len(item))
    if n:
        shared = {tuple(text[k : k + n]) for k in range(len(text) - n + 1)} & {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
        a, b = spark_rows(text, n), spark_rows(item, n)
        assert not shared or set(a) & set(b)


@pytest.fixture(scope="module")
def spark_rows(spark):
    def kept(words, span):
        ws = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
        return spark.range(1).select(decontamination.fingerprints(ws, [span])).first()[0]

    return kept


def test_only_operators_of_the_engine_in_its_plan(spark):
    found = decontamination.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert "Python" not in found._jdf.queryExecution().toString()
