from pyspark.sql import functions as F

from corpus_jobs.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        key = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(key, []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    return {i: (rows[min(g)[3]][0], len(g)) for g in groups.values() for *_, i in g}


def check(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, digest long").repartition(3)
    got = exact_dedup.exact_groups(docs, **options).collect()
    want = sorted(((rows[i][0], k, n) for i, (k, n) in brute(rows).items()), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == len({"".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r") for _, t in rows})
    return docs


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a  b"), (5, None), (6, ""), (7, " \n"), (8, "x y"), (9, "xy"), (None, "ab"), (11, "B"), (11, "B"), (12, "q" * 100_000)]


def test_groups_and_keepers(spark):
    check(spark, ROWS)


def test_several_batches_and_colliding_digests(spark):
    def weak(text):
        return F.unhex(F.lpad(F.hex(F.length(text) % 2), 2, "0"))

    check(spark, ROWS * 3, digest=weak, bytes_per_trigger=1)


def test_large_group(spark):
    check(spark, [(i, "same  text" if i % 2 else "sametext") for i in range(300)])


def test_drop_copies_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame([(d, t, "en") for d, t in ROWS], "doc_id long, text string, lang string")
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([3, 7, 8, 9, 11, 12], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(docs).count() == 0
