import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from corpus_jobs.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = SentencePieceProcessor(model_file=PATH)
CODEC = pieces.PieceCodec(PATH, keep=200)


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in CODEC.encode(texts)]


def test_hard_texts_have_the_library_ids():
    rng = random.Random(3)
    texts = ["", "  \n", "Hello  world", "a\tb", "😀😀 x", "日本語 テキスト", "\x00a\x00", "▁▁x", " lead", "trail ", "\n\n\n", "a" * 700, "x" * 100 + " y", "<s> </s> <unk> <0x41>", "ﬁ ½", "    four", "ab\r\ncd"]
    texts += ["".join(rng.choice("abcdefgh /=é一😀\n") for _ in range(n)) for n in (50, 500, 5000)]
    assert ids(texts) == [SP.encode(t) for t in texts]
    for text, raw in zip(texts, CODEC.encode(texts), strict=True):
        assert CODEC.decode(raw) == SP.decode(SP.encode(text))


def test_long_unbroken_words_have_the_library_ids():
    rng = random.Random(8)
    for alphabet in ("a", "ab", "ACGT", "abcdefghijklmnopqrstuvwxyz", "Aa0+/é一😀", "thein"):
        for n in (255, 257, 30_000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert ids([text, f"x {text} y {text}z"]) == [SP.encode(text), SP.encode(f"x {text} y {text}z")]
    periodic = ("thein" * 20_000)[:90_001]
    assert ids([periodic]) == [SP.encode(periodic)]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "a"])
def test_a_word_of_two_million_letters_in_bounded_memory(alphabet):
    """In a process of its own, whose memory is measured."""
    code = f"""
import random, resource, sys
from corpus_jobs.llm import pieces
codec = pieces.PieceCodec({PATH!r})
codec.encode(["some words first"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = "".join(random.Random(1).choices({alphabet!r}, k=2_000_000))
(out,) = codec.encode([text])
assert codec.decode(out) == text
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ, timeout=300, check=True)
    assert int(run.stdout) < 350


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), max_size=4))
def test_any_texts_have_the_library_ids_and_come_back(texts):
    assert ids(texts) == [SP.encode(t) for t in texts]
    assert [CODEC.decode(x) for x in CODEC.encode(texts)] == [t.replace("▁", " ") for t in texts]


def test_columns(spark):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (None, "", "x"), (4, "same same " * 30_000, "x"), (4, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = pieces.encode(df, PATH)
    got = sorted(((r["doc_id"], list(r["ids"])) for r in coded.collect()), key=str)
    assert got == sorted(((i, SP.encode(t or "")) for i, t, _ in rows), key=str)
    back = sorted(((r["doc_id"], r["text"]) for r in pieces.decode(coded, PATH).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert {(r["doc_id"], r["n_tokens"]) for r in pieces.digests(df.drop("ids"), PATH).collect()} == {(i, len(SP.encode(t or ""))) for i, t, _ in rows}
    assert pieces.encode(df.where("false"), PATH).count() == 0
