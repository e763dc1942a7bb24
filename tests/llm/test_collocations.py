import random
import re
from collections import Counter

import numpy as np
import pytest

from corpus_jobs.llm import collocations

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def pieces(text):
    return [w for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)) if (w := [x for x in re.split("[ \t]+", p) if x])]


def brute(rows, least, top, longest=4, share=80):
    counts, n = {}, Counter()
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter()) if lang is None or lang else counts.setdefault("", Counter())
        for ws in pieces(text):
            n[lang if lang is not None else "und"] += len(ws)
            for m in range(1, longest + 1):
                own.update(tuple(ws[k : k + m]) for k in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in found.items():
            inside = [b for q, b in found.items() if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))]
            if any(100 * b >= share * a for b in inside):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["New", "york", "city", "the", "of", "é", "ß", "don't", "x\x1cy", "日本", "a\xa0b", *(f"rare{i}" for i in range(300))]
    rows = []
    for i in range(200):
        parts = []
        for _ in range(rng.randrange(0, 30)):
            parts.append("New  York city" if rng.random() < 0.3 else "state of the" if rng.random() < 0.3 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", "\t", ". ", ",", "\r\n", " \t "]))
        rows.append(("".join(parts), rng.choice(["en", "fr", None])))
    return [*rows, (None, "en"), ("", None), (" .,; ", "xx"), ("the the the the the the the the the the " * 3000, "en"), *rows[:5]]


@pytest.mark.parametrize("least,top,bits", [(3, 2000, 64), (10, 5, 64), (2, 50, 14)])
def test_phrases_as_counted_one_by_one(spark, least, top, bits):
    rows = corpus()
    docs = spark.createDataFrame([(t, lang, 1, "w") for t, lang in rows], "text string, lang string, n long, words string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, top=top, bits=bits).collect())
    assert got == brute(rows, least, top)


def test_rare_runs_are_cut_and_nothing_else(spark):
    """With few buckets all runs pass, with many only frequent ones; the phrases are the same."""
    docs = spark.createDataFrame(corpus(), "text string, lang string")
    found = []
    for bits in (15, 25):
        found.append(sorted(map(tuple, collocations.collocations(docs, least=4, bucket_bits=bits).collect())))
    assert found[0] == found[1] and found[0]


def test_rows_with_equal_keys_are_told_apart(monkeypatch):
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 500), rng.integers(-3, 3, 500), np.zeros(500, np.int64)]
    want = Counter(zip(*(c.tolist() for c in columns), strict=True))
    for mix in (collocations._mix, lambda x, column: x):
        monkeypatch.setattr(collocations, "_mix", mix)
        first, n = collocations._distinct_rows(columns)
        assert dict(zip(zip(*(c[first].tolist() for c in columns), strict=True), n.tolist(), strict=True)) == want and len(first) == len(want)
    assert [len(x) for x in collocations._distinct_rows([np.zeros(0, np.int64)])] == [0, 0]


def test_empty_table(spark):
    docs = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs).count() == 0


def test_counts_beyond_64_bits_of_products(spark):
    wide = spark.range(1).selectExpr("cast(9000000000000000000 as bigint) as a", "cast(1 as bigint) as l", "cast(9223372036854775807 as bigint) as r")
    score = wide.select((collocations._wide("a") * 2_000_000).alias("_a"), (collocations._wide("l") + collocations._wide("r")).alias("_lr")).selectExpr("_a div _lr").first()[0]
    assert score == 2_000_000 * 9 * 10**18 // 2**63
