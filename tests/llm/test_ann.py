import numpy as np
from pyspark.sql import functions as F

from corpus_jobs.llm import ann


def brute(ids, x, query, k):
    d = np.sqrt(np.square(x - x[ids.index(query)]).sum(axis=1))
    rows = sorted((float(v), i) for v, i in zip(d, ids, strict=True) if i != query)
    return rows[:k]


def test_recall_and_scores_against_brute_force(spark):
    x = np.random.default_rng(3).standard_normal((3000, 32)).astype(np.float32)
    x[10] = x[11] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, k=10, block=800, chunk=16).toPandas()
    hit = 0
    for query, rows in got.groupby("query_id"):
        want = brute(list(range(3000)), x.astype(float), query, 10)
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 11))
        exact = {i: d for d, i in brute(list(range(3000)), x.astype(float), query, 3000)}
        assert all(abs(exact[i] - s) < 1e-12 for i, s in zip(rows["vec_id"], rows["score"], strict=True))
        assert rows["score"].is_monotonic_increasing
        hit += len({i for _, i in want} & set(rows["vec_id"]))
        if query == 0:
            assert rows["vec_id"].tolist()[:2] == [10, 11]
    assert got["query_id"].nunique() == 30 and hit / 300 >= 0.9


def test_repeated_ids(spark):
    x = np.random.default_rng(6).standard_normal((300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (100, x[7].tolist()), (50, x[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, k=10, block=150, chunk=2, threshold=0.0).orderBy("query_id", "rank").collect()
    for query in (0, 100, 200):
        own = [np.array(v) for i, v in rows if i == query]
        want = sorted((min(float(np.sqrt(np.square(np.array(v) - o).sum())) for o in own), i) for i, v in rows if i != query)[:10]
        mine = [r for r in got if r["query_id"] == query]
        assert [(r["rank"], r["vec_id"]) for r in mine] == [(k + 1, i) for k, (_, i) in enumerate(want)]
        assert all(abs(r["score"] - d) < 1e-12 for r, (d, _) in zip(mine, want, strict=True))


def test_every_length_is_searched_among_its_own(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(4 if i % 3 else 6)) for i in range(600)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, k=10, block=150, chunk=2, threshold=0.0).orderBy("query_id", "rank").collect()
    for query in range(0, 600, 100):
        own = rows[query][1]
        want = sorted((float(np.sqrt(np.square(v - own).sum())), i) for i, v in rows if i != query and len(v) == len(own))[:10]
        assert [r["vec_id"] for r in got if r["query_id"] == query] == [i for _, i in want]


def test_rows_that_take_no_part_and_few_candidates(spark):
    bad = [None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0], []]
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (None, [1.0, 1.0]), (200, None), *((i + 10, v) for i, v in enumerate(bad))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 100 == 0, k=10).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 0.0), (100, 2, 2, 5**0.5)]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
