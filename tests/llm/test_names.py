"""Every public function with extra columns of all names that the operators use inside, and with repeated rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpus_jobs.llm import ann, chat, common, exact_dedup, language, packing, pieces, quality, secrets, simhash, warc

NAMES = """_metadata _locator _text _in _bucket _bitmap _id _y _findings _bases _runs _taken _b64 _hexes _salts _salt _rank _base _n _length _first _end _q
_sequence _offset _stored _kept _file _row file row fp root size digest chars first n kept body raw copies least part a b m t l k v id lang gram total rate top slot word mask
block chunk query_id rank vec doc turns head value""".split()
MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ROWS = [(1, "the cat and the dog token=abcdefgh1", "en"), (1, "the cat and the dog token=abcdefgh1", "en"), (2, "el perro y la casa", "es"), (3, None, None), (4, "", "en"), (5, "the  cat and the dog token=abcdefgh1", "en")]


@pytest.fixture(scope="module")
def plain(spark):
    return common.materialise(spark.createDataFrame(ROWS, "doc_id long, text string, language string"), "names")


@pytest.fixture(scope="module")
def wide(plain):
    return common.materialise(plain.selectExpr("*", *(f"'{c}' AS `{c}`" for c in NAMES)), "names")


def same(plain, wide, f, replaced=()):
    """f gives the same for both but for the extra columns, which stay as they were."""
    want, got = f(plain), f(wide)
    extra = [c for c in NAMES if c not in replaced]
    assert set(got.columns) == set(want.columns) | set(extra)
    rows = got.collect()
    assert sorted((str([r[c] for c in want.columns]) for r in rows)) == sorted(str(list(r)) for r in want.collect())
    assert all(r[c] == c for r in rows for c in extra)
    assert len(rows) > 0


def test_functions_that_keep_columns(plain, wide):
    model = language.fit(plain, lang="language", bits=12)
    same(plain, wide, lambda df: language.predict(df, model))
    same(plain, wide, simhash.fingerprints, replaced=("fp",))
    same(plain, wide, quality.with_features)
    additive = quality.fit_model(*_some())
    same(plain, wide, lambda df: quality.score(quality.with_features(df), additive))
    same(plain, wide, lambda df: quality.score_texts(df, additive))
    same(plain, wide, lambda df: pieces.encode(df, MODEL))
    same(plain, wide, lambda df: pieces.decode(pieces.encode(df, MODEL), MODEL))
    same(plain, wide, lambda df: pieces.digests(df, MODEL))
    same(plain, wide, secrets.scan_secrets)
    same(plain, wide, exact_dedup.drop_copies)
    same(plain, wide, simhash.drop_near_copies)
    cut = packing.cut(plain, WORDS)
    wide_cut = cut.selectExpr("*", *(f"'{c}' AS `{c}`" for c in NAMES))
    same(cut, wide_cut, packing.pack)


def test_rows_that_come_from_no_file(plain):
    """A column named _metadata stands where the files' hidden one isn't."""
    wide = plain.selectExpr("*", *(f"'{c}' AS `{c}`" for c in NAMES))
    same(plain, wide, exact_dedup.drop_copies)
    same(plain, wide, simhash.drop_near_copies)


def _some():
    import numpy as np

    x = np.random.default_rng(1).random((200, len(quality.FEATURES)))
    return x, (x[:, 0] > 0.5).astype(float)


def test_functions_that_read_some_columns(spark, plain, wide):
    def rows(df):
        return sorted(map(str, df.collect()))

    drop = [c for c in wide.columns if c in ("a", "b")]
    assert rows(exact_dedup.exact_groups(wide).drop("_locator")) == rows(exact_dedup.exact_groups(plain).drop("_locator"))
    assert rows(simhash.near_groups(wide)) == rows(simhash.near_groups(plain))
    assert language.fit(wide, lang="language").languages == language.fit(plain, lang="language").languages == ["en", "es"]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None)], "doc_id long, quality int")
    wide_labels = labels.selectExpr("*", *(f"'{c}' AS `{c}`" for c in NAMES))
    one, two = (quality.fit(quality.with_features(df), y) for df, y in ((plain, labels), (wide, wide_labels)))
    assert one.prior == two.prior and [t.tolist() for t in one.tables] == [t.tolist() for t in two.tables]
    assert rows(packing.cut(wide.drop(*drop), WORDS)) == rows(packing.cut(plain, WORDS))
    turns = [df.withColumnRenamed("doc_id", "conv_id").withColumns({"turn": F.col("conv_id"), "role": F.lit("user")}) for df in (plain, wide)]
    assert rows(chat.format_chats(turns[0])) == rows(chat.format_chats(turns[1]))
    pages = [df.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.lit("u")) for df in (plain, wide)]
    assert warc.records(pages[1]).count() == warc.records(pages[0]).count() == len(ROWS)
    vectors = [df.withColumnRenamed("doc_id", "vec_id").withColumn("embedding", F.array(F.length("text").cast("double"), F.lit(1.0))) for df in (plain, wide)]
    assert rows(ann.nearest(vectors[0], F.col("vec_id") == 1, k=3)) == rows(ann.nearest(vectors[1], F.col("vec_id") == 1, k=3)) != []
