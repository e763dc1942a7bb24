import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_jobs.llm import packing
from corpus_jobs.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1, max_size=40))
def test_plan_places_every_piece_once(histogram):
    places, sequences = packing.plan(histogram, 64, small=0.34, groups=6)
    ranks = {length: [] for length in histogram}
    filled = {}
    for length, first, end, q, sequence, offset in places:
        ranks[length] += range(first, end)
        for i in range(end - first):
            filled.setdefault(sequence + i // q, []).append((offset + i % q * length, length))
    assert all(sorted(ranks[length]) == list(range(n)) for length, n in histogram.items())
    assert sorted(filled) == list(range(sequences))
    for items in filled.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("n", [500, 20_000])
def test_plan_is_tight(n):
    lengths = np.random.default_rng(1).exponential(900, n).astype(int) % 2048 + 1
    values, counts = np.unique(lengths, return_counts=True)
    _, sequences = packing.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), 2048)
    assert sequences <= 1.01 * lengths.sum() / 2048 + 2


def test_words_give_the_ids_of_whole_texts():
    words = WordIds(PATH, keep=5)
    texts = ["Hello, world. it's don't; a.b,c ..., x", "İstanbul ΣΑΣ É ñ, ß. 日本語 １２", "áé́,", "a\x1cb\x1d\x85c\xa0d", "", " \n\t", "Hello again, Hello.", "ab***, it's' a'*** word$$$ x!! 'tis y'S*' a-b-. (c) _d_ e1** é** ,. **", "<|endoftext|> 1,2."]
    for _ in range(2):
        for text, raw in zip(texts, words(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


#: Letters that lower-casing or normalising takes apart or reorders, marks that combine, and what stands beside them.
ODD = [*"aAzZÉéßÀÅΣςσİıŒǅǈＡﬁﬀ１", *"WTJYHweo", *(chr(c) for c in (0x300, 0x301, 0x307, 0x308, 0x30A, 0x30C, 0x327, 0x323, 0x345, 0x93C, 0x5BC, 0x94D, 0x200D)), *"जडढगड़ढ़क़שׁאּכּ가각ᄀ", *"  \t\n\x1c\x85\xa0\u2028", *".,!?;:'\"()*-_#$[]{}<>@/\\|~`^%&+=", *"日本東漢豈", "\u0130\u0327", "W\u030a", "T\u0308", "J\u030c", "जड़,", "गढ़.", "\ufb2a.", "😀", "a" * 120, "<|endoftext|>", "\ufdfa", "\U0001d400", "\u1e9e"]


@pytest.fixture(scope="module")
def words():
    return WordIds(PATH, keep=2000)


def hold(words, texts):
    for text, raw in zip(texts, words(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(ODD), max_size=25).map("".join)), max_size=30))
def test_ids_are_the_librarys_over_all_of_unicode(words, texts):
    hold(words, texts)


@pytest.mark.parametrize("text", ["W\u030ar", "T\u0308", "J\u030c", "\u0130\u0327", "जड़,", "गढ़.", "\ufb2a.", "\u095c\u095d, x", "É\u0301\u0327.", "ΑΣ. ΣΑ", "\u0130, \u0958"])
def test_letters_that_come_apart(words, text):
    hold(words, [text, f"a {text} b", f"{text}{text}", text.lower(), text.upper()])


def test_documents_are_cut_and_packed_whole(spark):
    texts = ["word " * 40, "a b c", "", None, "x, " * 300, "a b c", "é" * 50]
    docs = spark.createDataFrame([(i if i != 4 else None, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, length string, offset int")
    out = packing.pack_documents(docs, PATH, capacity=16, end_id=0, with_ids=True).collect()
    tokenizer = WordIds(PATH).tokenizer
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted((r for r in out if r["doc_id"] == (i if i != 4 else None)), key=lambda r: r["piece"])
        assert [x for r in pieces for x in r["ids"]] == ids
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 16))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in pieces)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        assert [o for o, _ in sorted(items)] == np.cumsum([0, *(n for _, n in sorted(items))])[:-1].tolist() and sum(n for _, n in items) <= 16


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")] * 40, "doc_id long, text string")
    out = packing.pack_documents(docs, PATH, capacity=8).collect()
    assert len(out) == 40 and len({(r["sequence_id"], r["offset"]) for r in out}) == 40
    assert packing.pack_documents(docs.where("false"), PATH).count() == 0
