import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_jobs.operators import bitmaps, blocks, dialogs, lexical, tags, vectors
from corpus_jobs.operators.fusion import reciprocal_rank_fusion
from corpus_jobs.operators.notes import visible_chunks
from corpus_jobs.params import Chunking, Dialogs, Embedding, Ranking
from corpus_jobs.plans import jobs, queries, tables


def ranked(df, *columns):
    return [tuple(r[c] for c in ("query_id", "rank", *columns)) for r in df.orderBy("query_id", "rank").collect()]


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("a", 0, "", None, "cat cat dog"), ("b", 0, "", None, "cat fish"), ("c", 0, "", None, "...")], "slug string, chunk_index int, title string, heading string, text string")
    queries = spark.createDataFrame([(1, "cat CAT bird"), (2, "..."), (3, "zebra")], "query_id long, text string")
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))

    def part(tf, size):
        return idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / (5 / 3)))

    got = ranked(lexical.rank_lexical(queries, chunks, 5), "slug", "score")
    assert [g[:3] for g in got] == [(1, 1, "a"), (1, 2, "b")]
    assert got[0][3] == pytest.approx(2 * part(2, 3), abs=1e-9) and got[1][3] == pytest.approx(2 * part(1, 2), abs=1e-9)
    assert lexical.rank_lexical(queries, chunks, 0).count() == 0
    assert lexical.rank_lexical(queries, chunks.where("false"), 5).count() == 0


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_bm25_against_plain_python(spark, bound):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    data = [(f"s{i % 7}", i // 7, "T", "h", " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(60)]
    asked = [(q, " ".join(rng.choices(words, k=4))) for q in range(6)]
    docs = {(s, i): f"t h {x}".split() for s, i, _, _, x in data}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    want = []
    for q, text in asked:
        scores = []
        for key, d in docs.items():
            tf = Counter(d)
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in text.split() if tf[t])
            if s:
                scores.append((-round(s, 10), *key))
        want += [(q, r + 1, s, i) for r, (_, s, i) in enumerate(sorted(scores)[:5])]
    chunks = spark.createDataFrame(data, "slug string, chunk_index int, title string, heading string, text string").repartition(3)
    got = lexical.rank_lexical(spark.createDataFrame(asked, "query_id long, text string"), chunks, 5, broadcast_bytes=bound)
    assert ranked(got, "slug", "chunk_index") == want


def test_all_scores_are_made_where_chunks_are_read(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    data = [(f"s{i % 50}", i // 50, "T", "h", " ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(2500)]
    chunks = spark.createDataFrame(data, "slug string, chunk_index int, title string, heading string, text string").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(rng.choices([*words, "none"], k=3))) for q in range(300)] + [(None, "w1"), (300, "none"), (301, None)], "query_id long, text string")
    near = lexical.score_lexical(queries, chunks)
    got, want = ({tuple(r)[:3]: r["score"] for r in df.collect()} for df in (near, lexical.score_lexical(queries, chunks, broadcast_bytes=0)))
    assert got == pytest.approx(want, abs=1e-9) and len(got) == near.count() and (None, "s0", 0) in {(q, "s0", 0) for q, *_ in got}
    assert not exchanged(near)
    assert lexical.score_lexical(queries.where("false"), chunks).count() == lexical.score_lexical(queries, chunks.where("false")).count() == 0


def test_terms_are_summed_by_batch(spark):
    chunks = spark.createDataFrame([(f"s{i}", 0, "T", "h", f"a a b {'ß' * (i % 2)} c.d.") for i in range(3000)], "slug string, chunk_index int, title string, heading string, text string").repartition(2)
    for rows in (lexical.documents(chunks), lexical.tokenized(chunks)):
        assert lexical._signed(rows, 1).count() <= 2 * 2 * 7
        assert {r["term"]: (r["df"], r["size"]) for r in lexical.term_totals(rows).collect()} == {"": (3000, 19500), **{x: (3000, 3000) for x in ("t", "h", "b", "c.d")}, "a": (3000, 6000), "ss": (1500, 1500)}


def test_bounded_sums_of_many_queries():
    """2,000 queries of frequent and rare terms over batches of chunks, many of them equal, against all products."""
    rng = np.random.default_rng(4)
    n_terms, n_queries, n_rows, k = 3000, 2000, 4096, 10
    shares = 1 / np.arange(1, n_terms + 1)
    shares /= shares.sum()
    chunks = [dict(zip(*np.unique(rng.choice(n_terms, rng.integers(0, 120), p=shares), return_counts=True), strict=True)) for _ in range(n_rows // 2)]
    chunks = [c for c in chunks for _ in range(2)]
    df = np.zeros(n_terms)
    for c in chunks:
        df[list(c)] += 1
    idf = np.log(1 + (n_rows - df + 0.5) / (df + 0.5))
    asked = [np.unique(rng.choice(n_terms, 12, p=shares)) for _ in range(n_queries)]
    query, term = np.repeat(np.arange(n_queries), [len(a) for a in asked]), np.concatenate(asked)
    sums = blocks.BoundedSums(query, term, idf[term], n_queries, n_terms)
    best = blocks.Best(n_queries, k)
    names, numbers = [f"s{i * 7919 % 1000:04}" for i in range(n_rows)], np.arange(n_rows)
    dense, weights = np.zeros((n_rows, n_terms)), np.zeros((n_terms, n_queries))
    np.add.at(weights, (term, query), idf[term])
    for i, c in enumerate(chunks):
        for t, tf in c.items():
            dense[i, t] = tf * 2.5 / (tf + 1.5)
    for at in range(0, n_rows, 1024):
        own = slice(at, at + 1024)
        rows, terms = np.nonzero(dense[own])
        order = blocks.in_order(pa.array(names[own]), pa.array(numbers[own]))
        sums.offer(best, rows, terms, dense[own][rows, terms], names[own], numbers[own], order, most=300_000)
    scores = np.round(dense @ weights, 10)
    matching = ((dense > 0).astype(float) @ (weights > 0)).sum()
    assert sums.products < matching  # fewer than all matching entries, far below rows x terms x queries
    got = {}
    for q, slug, number, key in zip(*best.found(), strict=True):
        got.setdefault(q, []).append((key, slug, number))
    for q in range(n_queries):
        near = np.flatnonzero(scores[:, q] > 0)
        want = sorted((-scores[i, q], names[i], i) for i in near)[:k]
        assert [(round(x, 9), s, i) for x, s, i in got.get(q, [])] == [(round(x, 9), s, i) for x, s, i in want]


@pytest.mark.parametrize("most", [4_000_000, 5000])
def test_few_queries_are_multiplied_as_matrices(most):
    """The same best rows as by looking entries up, in blocks of queries and slices of rows, with ties between equal rows."""
    rng = np.random.default_rng(5)
    n_terms, n_queries, n_rows = 90, 300, 1500
    cells = np.unique(rng.integers(0, n_rows // 2 * n_terms, 30_000))
    rows, terms = np.divmod(cells, n_terms)
    parts = rng.integers(1, 9, len(rows)) / 4
    rows, terms, parts = np.concatenate([rows, rows + n_rows // 2]), np.tile(terms, 2), np.tile(parts, 2)
    query, term = np.divmod(np.unique(rng.integers(0, n_queries * n_terms, 3000)), n_terms)
    weight = rng.integers(1, 99, len(query)) / 8
    names, numbers = [f"s{i * 7919 % 400:03}" for i in range(n_rows)], np.arange(n_rows)
    order = blocks.in_order(pa.array(names), pa.array(numbers))
    found = []
    for cheaper in (1500, 0):
        sums, best = blocks.BoundedSums(query, term, weight, n_queries, n_terms), blocks.Best(n_queries, 7)
        sums.CHEAPER = cheaper
        for _ in range(2):
            sums.offer(best, rows, terms, parts, names, numbers, order, most=most)
        assert bool(sums.products) == (cheaper == 0) == (not sums.matrices)
        found.append(best.kept)
    assert found[0] == found[1] and len(found[0]) == len(set(query))


def test_totals_follow_random_syncs(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(15)]

    def state(old):
        """Some chunks stay, some change, some go, some come; texts may be empty or repeated."""
        rows = {key: (title, text) for key, (title, text) in old.items() if rng.random() < 0.7}
        for _ in range(25):
            rows[f"s{rng.randrange(20)}", rng.randrange(3)] = (rng.choice(["", "T w1"]), rng.choice(["", "w1 w1", " ".join(rng.choices(words, k=rng.randint(0, 9)))]))
        return rows

    def table(rows):
        return spark.createDataFrame([(s, i, title, None, text) for (s, i), (title, text) in rows.items()], "slug string, chunk_index int, title string, heading string, text string")

    now = {}
    totals = lexical.term_totals(lexical.tokenized(table({("x", 0): ("", "")}).where("false")))
    for step in range(4):
        then, now = now, state(now) if step < 3 else {}
        gone, come = lexical.document_changes(table(then or {("x", 0): ("", "")}).where("slug != 'x'"), table(now or {("x", 0): ("", "")}).where("slug != 'x'"))
        kept = lexical.moved_totals(totals, lexical.tokenized(gone), lexical.tokenized(come)).collect()
        want = {}
        for title, text in now.values():
            ts = f"{title} {text}".lower().split()
            for term, n in [*Counter(ts).items(), ("", len(ts))]:
                df, size = want.get(term, (0, 0))
                want[term] = df + 1, size + n
        assert {r["term"]: (r["df"], r["size"]) for r in kept} == want
        totals = spark.createDataFrame(kept, "term string, df long, size long")
        stats, frequencies = lexical.statistics_of(totals)
        assert tuple(stats.first()) == ((len(now), want[""][1] / len(now)) if now else (0, 0.0))
        assert {r["term"]: r["df"] for r in frequencies.collect()} == {term: df for term, (df, _) in want.items() if term}


def test_a_task_gives_each_query_once(spark):
    chunks = spark.createDataFrame([(f"s{i}", 0, "T", "h", f"cat w{i % 5}") for i in range(5000)], "slug string, chunk_index int, title string, heading string, text string").repartition(3)
    asked = pa.table({"query_id": [1, 2], "term": ["cat", "w1"]})
    matched = lexical.matched_terms(lexical.tokenized(chunks), asked["term"].to_pylist())
    sums = blocks.BoundedSums(np.array([0, 1]), np.array([0, 1]), np.array([1.0, 1.0]), 2, 2)
    found = lexical._best_of_tasks(matched, sums, asked["query_id"].combine_chunks(), "bigint", 4.0, 7, 1.5, 0.75)
    assert found.count() == 3 * 2 * 7


@pytest.mark.parametrize("kind,most", [("clustered", 0.12), ("uniform", 1.0)])
def test_balls_leave_out_what_is_too_far(kind, most):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 24))
    if kind == "clustered":
        x = x * 0.05 + rng.standard_normal((60, 24))[rng.integers(0, 60, 6000)]
    x[100:140] = x[99]  # more equal ones than are asked for
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    balls = vectors.Balls(np.arange(6000), x)
    asked = np.concatenate([x[::97], rng.standard_normal((20, 24))])
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    best = blocks.Best(len(asked), 10)
    names, numbers = [f"{i * 7919 % 6000:04}" for i in range(6000)], np.arange(6000)
    balls.offer(best, np.arange(len(asked)), asked, names, numbers, blocks.in_order(pa.array(names), pa.array(numbers)))
    distance = np.round(1 - asked @ x.T, vectors.DIGITS)
    for q in range(len(asked)):
        want = sorted(zip(distance[q].tolist(), names, range(6000), strict=True))[:10]
        assert [(s, i) for _, s, i in sorted(best.kept[q])] == [(s, i) for _, s, i in want]
    assert balls.scored <= most * balls.possible


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_vectors_of_other_sizes_come_last(spark, bound):
    chunks = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 1.0]), ("c", 0, [1.0, 0.0, 0.0]), ("d", 0, []), ("e", 0, [0.0, 0.0]), ("f", 0, None), ("g", 0, [1.0, None])], "slug string, chunk_index int, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, []), (4, None)], "query_id long, embedding array<float>")
    got = ranked(vectors.semantic_top_k(queries, chunks, 9, broadcast_bytes=bound, block=2), "slug", "distance")
    assert got == [
        *((1, i + 1, s, d) for i, (s, d) in enumerate([("a", 0.0), ("b", 1.0), ("c", None), ("d", None), ("e", None), ("g", None)])),
        *((2, i + 1, s, d) for i, (s, d) in enumerate([("c", 1.0), ("a", None), ("b", None), ("d", None), ("e", None), ("g", None)])),
        *((3, i + 1, s, None) for i, s in enumerate("abcdeg")),
    ]


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_nearest_vectors_in_either_way(spark, bound):
    x = np.random.default_rng(0).standard_normal((200, 8)).astype(np.float32)
    x[7] = x[3]
    x[9] = 0
    rows = [(f"v{i}", 0, v.tolist()) for i, v in enumerate(x)] + [("none", 0, None)]
    chunks = spark.createDataFrame(rows, "slug string, chunk_index int, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 3, 50)] + [(999, None)], "query_id long, embedding array<float>")
    got = ranked(vectors.semantic_top_k(queries, chunks, 6, broadcast_bytes=bound, block=37), "slug")
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-30)
    want = []
    for i in (0, 3, 50):
        d = np.round(1 - unit @ unit[i], 12)
        d[9] = np.inf
        want += [(i, r + 1, s) for r, (_, s) in enumerate(sorted(zip(d, (f"v{j}" for j in range(200)), strict=True))[:6])]
    assert got == want
    assert vectors.semantic_top_k(queries, chunks, 0).count() == 0
    everything = vectors.semantic_top_k(queries.where("query_id = 0"), chunks, 500, broadcast_bytes=bound, block=37)
    assert everything.count() == 200 and [r["slug"] for r in everything.where("distance IS NULL").collect()] == ["v9"]


def test_fusion_by_hand(spark):
    semantic = spark.createDataFrame([(1, "a", 0, 1, 0.1), (1, "b", 0, 2, 0.2), (1, "a", 0, 3, 0.3)], "query_id long, slug string, chunk_index int, rank int, distance double")
    words = spark.createDataFrame([(1, "b", 0, 1), (1, "c", 0, 2), (2, "c", 1, 1)], "query_id long, slug string, chunk_index int, rank int")
    got = ranked(reciprocal_rank_fusion(semantic, words, 2), "slug", "distance", "score")
    assert got == [(1, 1, "b", 0.2, round(1 / 62 + 0.7 / 61, 12)), (1, 2, "a", 0.1, round(1 / 61, 12)), (2, 1, "c", 0.0, round(0.7 / 61, 12))]
    assert ranked(reciprocal_rank_fusion(semantic, words, 9, lexical_weight=0.0), "slug", "score")[-2:] == [(1, 3, "c", 0.0), (2, 1, "c", 0.0)]
    assert reciprocal_rank_fusion(semantic, words, 0).count() == 0


def test_tag_neighbors(spark):
    tagged = spark.createDataFrame([("a", ["x", "y"]), ("b", ["q", "y", "x"]), ("c", ["z"]), ("d", [])], "slug string, tags array<string>")
    hits = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c"), (3, "gone")], "query_id long, slug string")
    assert [tuple(r) for r in tags.tag_neighbors(hits, tagged).collect()] == [(1, "b", ["y", "x"])]


def world(spark):
    notes = spark.createDataFrame([(s, f"/notes/{s}.html", s.upper(), p, d, t) for s, p, d, t in (("a", True, "2024", ["x"]), ("b", True, "2024", ["x", "k"]), ("c", True, "2999", ["x"]), ("d", False, "2024", ["x"]), ("e", True, "2024", ["k"]))], "slug string, url string, title string, published boolean, date string, tags array<string>")
    chunks = spark.createDataFrame([(s, 0, "h", f"{s} words", v) for s, v in (("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.1]), ("d", [1.0, 0.0]), ("e", [0.6, 0.8]))], "slug string, chunk_index int, heading string, text string, embedding array<float>")
    return notes, chunks, spark.createDataFrame([(1, "a", [1.0, 0.0])], "query_id long, text string, embedding array<float>")


def test_search_and_widening(spark):
    notes, chunks, asked = world(spark)
    hits = jobs.hybrid_search(asked, chunks, notes, "2025", Ranking(top_k=1))
    assert [(r["slug"], r["title"], r["text"]) for r in hits.collect()] == [("a", "A", "a words")]
    assert [r["slug"] for r in jobs.hybrid_search(asked, chunks, notes, "2025").orderBy("rank").collect()] == ["a", "e", "b"]
    near = jobs.expand_neighbors(asked, hits, chunks, notes, "2025", 2)
    assert [(r["slug"], r["shared_tags"], r["rank"]) for r in near.collect()] == [("b", ["x"], 1)]
    assert jobs.expand_neighbors(asked, hits, chunks, notes, "2025", 0).count() == 0
    assert jobs.hybrid_search(asked, chunks, notes, "2025", Ranking(top_k=0)).count() == 0


def exchanged(df):
    """The names of the columns that go through each shuffle of a plan."""
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            found.append([node.output().apply(i).name() for i in range(node.output().size())])
    return found


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_search_shuffles_no_text_or_vector_of_the_corpus(spark, tmp_path, bound, monkeypatch):
    """With broadcast joins off, nothing but keys and counts of the corpus goes through a shuffle, in any job of a search."""
    rng = random.Random(2)
    notes = spark.createDataFrame([(f"s{i}", f"/n/{i}", f"T{i} w{i % 7}", i % 9 != 4, "2024", ["x"]) for i in range(80)], "slug string, url string, title string, published boolean, date string, tags array<string>")
    data = [(f"s{i}", j, "h", " ".join(rng.choices([f"w{n}" for n in range(20)], k=8)), np.random.default_rng(i * 2 + j).standard_normal(4).astype(np.float32).tolist()) for i in range(90) for j in range(2)]
    spark.createDataFrame(data, "slug string, chunk_index int, heading string, text string, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    asked = spark.createDataFrame([(q, f"w{q} w3 t{q}", np.random.default_rng(900 + q).standard_normal(4).astype(np.float32).tolist()) for q in range(5)], "query_id long, text string, embedding array<float>")
    want = ranked(jobs.hybrid_search(asked, chunks, notes, "2025"), "slug", "chunk_index", "score", "text", "title")
    titled = visible_chunks(chunks, notes, "2025")
    both = reciprocal_rank_fusion(vectors.semantic_top_k(asked, titled, 24), lexical.rank_lexical(asked, titled, 24), 6)
    assert [w[:5] for w in want] == ranked(both, "slug", "chunk_index", "score") and len(want) == 30
    plans = []
    for module in (bitmaps, lexical, jobs):
        monkeypatch.setattr(module, "materialise", lambda df, label, write=module.materialise: plans.append((label, df)) or write(df, label))
    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = jobs.hybrid_search(asked, chunks, notes, "2025", broadcast_bytes=bound)
        assert ranked(found, "slug", "chunk_index", "score", "text", "title") == want
        visible = bitmaps.rows_of(chunks, "slug", notes.where("published"), bound)
        assert all(names == ["slug"] for names in exchanged(visible)) or bound == 0
        assert {r["slug"] for r in visible.collect()} == {f"s{i}" for i in range(80) if i % 9 != 4}
        if bound:
            assert len(plans) >= 3
            for label, df in [*plans, ("result", found)]:
                assert not {"text", "embedding", "tokens"} & {n for names in exchanged(df) for n in names}, label
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_vectors_meet_keys_of_chunks_not_their_texts(spark, tmp_path, monkeypatch):
    """The chunk table of the queries is made without a shuffle of texts, also where vectors are too many to broadcast."""
    docs = [(i, f" line {i}\n\n" * (i % 40) or None, "src" if i % 3 else None) for i in range(40)] + [(None, "a", "src")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 60, 2)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    plans = []
    monkeypatch.setattr(tables, "materialise", lambda df, label, write=tables.materialise: plans.append(df) or write(df, label))
    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        chunks, embeddings = tables.embedded_chunks(spark, str(tmp_path))
        assert len(plans) == 2 and not {"text"} & {n for df in plans for names in exchanged(df) for n in names}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    want = tables.chunks(spark, str(tmp_path))
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, want.drop("doc_id").collect()))
    placed = {(r["slug"], r["chunk_index"]): [float(r["doc_id"]), 1.0] if r["chunk_index"] == 0 and r["doc_id"] is not None and r["doc_id"] % 2 == 0 else None for r in want.collect()}
    assert {(r["slug"], r["chunk_index"]): r["embedding"] for r in embeddings.collect()} == placed and any(placed.values())


def test_vectors_apart_give_the_same_search(spark):
    notes, chunks, asked = world(spark)
    texts, apart = chunks.drop("embedding"), chunks.select("slug", "chunk_index", "embedding")
    for k in (1, 6):
        hits = jobs.hybrid_search(asked, chunks, notes, "2025", Ranking(top_k=k))
        got = jobs.hybrid_search(asked, texts, notes, "2025", Ranking(top_k=k), embeddings=apart)
        assert ranked(got, "slug", "chunk_index", "distance", "score", "text") == ranked(hits, "slug", "chunk_index", "distance", "score", "text")
    near, same = (jobs.expand_neighbors(asked, hits.limit(1), c, notes, "2025", 4, embeddings=e) for c, e in ((chunks, None), (texts, apart)))
    assert ranked(near, "slug", "chunk_index", "distance", "shared_tags") == ranked(same, "slug", "chunk_index", "distance", "shared_tags")


def test_a_search_and_its_widening_share_the_visible_notes(spark, monkeypatch):
    made = []
    monkeypatch.setattr(jobs, "materialise", lambda df, label, write=jobs.materialise: made.append(label) or write(df, label))
    assert queries.QUERIES["expand_neighbors"](spark, "/root/testdata/sf0.001").count() > 0
    assert made.count("visible-notes") == 1


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_rows_of_keys_exactly(spark, bits, monkeypatch):
    """Also where bitmaps are so small that most other keys pass them."""
    monkeypatch.setattr(bitmaps, "MOST_BITS", bits)
    rows = spark.createDataFrame([(f"k{i % 300}" if i % 50 else None, i, "x") for i in range(1000)], "slug string, n int, _bucket string").repartition(3)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 400, 3)] * 2 + [(None,)], "slug string")
    for bound in (0, 1 << 20):
        got, others = bitmaps.split_rows(rows, "slug", keys, bound)
        assert got.columns == others.columns == rows.columns
        assert sorted(r["n"] for r in others.collect()) == [i for i in range(1000) if not (i % 50 and (i % 300) % 3 == 0)]
        assert sorted(r["n"] for r in got.collect()) == [i for i in range(1000) if i % 50 and (i % 300) % 3 == 0]
    assert bitmaps.rows_of(rows, "slug", keys.where("false"), 0).count() == 0
    assert bitmaps.rows_of(rows.where("false"), "slug", keys, 0).count() == 0


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_titles_apart_give_the_same_ranking(spark, bound):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(9)]
    notes = spark.createDataFrame([(f"s{i}", " ".join(rng.choices(words, k=rng.randint(0, 3)))) for i in range(12)], "slug string, title string")
    chunks = spark.createDataFrame([(f"s{i % 14}", i // 14, rng.choice(words), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(70)], "slug string, chunk_index int, heading string, text string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=3))) for q in range(6)], "query_id long, text string")
    want = ranked(lexical.rank_lexical(asked, chunks.join(notes, "slug"), 7), "slug", "chunk_index", "score")
    assert ranked(lexical.rank_lexical(asked, chunks, 7, broadcast_bytes=bound, titles=notes), "slug", "chunk_index", "score") == want and len(want) > 30


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_widening_against_plain_python(spark, bound):
    rng, data = random.Random(5), np.random.default_rng(2)
    tagged = [(f"s{i}", f"/n/{i}", f"T{i}", i % 9 != 4, "2024", rng.sample("abcdefghij", rng.randint(0, 3)) if i % 8 else None) for i in range(60)]
    vectors = {(f"s{i}", j): None if (i + j) % 5 == 0 else [0.0] * 4 if (i + j) % 11 == 0 else data.standard_normal(4).astype(np.float32).tolist() for i in range(60) for j in range(2)}
    notes = spark.createDataFrame(tagged, "slug string, url string, title string, published boolean, date string, tags array<string>")
    chunks = spark.createDataFrame([(s, j, "h", f"text {s} {j}", v) for (s, j), v in vectors.items()], "slug string, chunk_index int, heading string, text string, embedding array<float>").repartition(3)
    asked = {q: None if q == 3 else data.standard_normal(4).astype(np.float32).tolist() for q in range(6)}
    hits = [(q, f"s{rng.randrange(60)}") for q in range(5) for _ in range(3)] + [(5, "gone")]
    got = jobs.expand_neighbors(spark.createDataFrame(list(asked.items()), "query_id long, embedding array<float>"), spark.createDataFrame(hits * 2, "query_id long, slug string"), chunks, notes, "2025", 4, broadcast_bytes=bound)
    assert set(got.columns) == {"query_id", "slug", "chunk_index", "heading", "text", "title", "url", "shared_tags", "distance", "rank"}
    shown = {s: t or [] for s, _, _, published, _, t in tagged if published}
    want = []
    for q, vector in asked.items():
        own = {s for a, s in hits if a == q}
        tags = {x for s in own for x in shown.get(s, [])}
        found = []
        for (s, j), v in vectors.items():
            if s in shown and s not in own and tags & set(shown[s]):
                good = vector is not None and v is not None and any(v)
                a, b = np.array(vector if good else [1.0]), np.array(v if good else [1.0])
                found.append((round(1 - float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b)), 9) if good else math.inf, s, j))
        want += [(q, r + 1, s, j, [x for x in shown[s] if x in tags], f"text {s} {j}") for r, (_, s, j) in enumerate(sorted(found)[:4])]
    assert ranked(got, "slug", "chunk_index", "shared_tags", "text") == want and len(want) > 12


def talk(spark, *messages):
    return spark.createDataFrame([(c, i, r, t) for c, turns in messages for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")


def test_validation(spark):
    df = talk(spark, (1, [("user", "q")]), (2, [("user", "q"), ("assistant", "a")]), (3, [("system", "s"), ("user", "q")]), (4, [("user", "x" * 4001)]), (5, [("user", "")]), (6, [("user", "q")] * 21), (7, [("user", None)]), (8, [(None, "q")]))
    got = {r["conv_id"]: r["reason"] for r in dialogs.validate_conversations(df).collect()}
    assert got == {1: None, 2: "last message is not from the user", 3: "unknown role", 4: "empty or too long message", 5: "empty or too long message", 6: "too many messages", 7: "empty or too long message", 8: "unknown role"}
    assert {r["conv_id"]: r["query"] for r in dialogs.query_from_conversation(df).collect()}[2] == "a"


def test_prompts(spark):
    notes, chunks, _ = world(spark)
    df = talk(spark, (1, [(("user", "assistant")[i % 2], f"m{i}") for i in range(11)]), (2, [("user", "hi")]), (3, [("user", "q"), ("assistant", "no")]))
    found = chunks.join(notes, "slug").select(F.lit(1).cast("long").alias("query_id"), "slug", "title", "url", "heading", "text")
    hits = found.where("slug = 'a'").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    related = found.where("slug IN ('a', 'b')").withColumns({"rank": F.lit(1), "shared_tags": F.array(F.lit("x"))})
    params = Dialogs(site="https://s", system="S")
    got = {r["conv_id"]: r for r in dialogs.build_prompts(df, hits, related, params).collect()}
    assert set(got) == {1, 2}
    assert got[1]["sources_json"] == '{"sources":[{"slug":"a","title":"A","url":"https://s/notes/a.html"},{"slug":"b","title":"B","url":"https://s/notes/b.html"}]}'
    system, *history = got[1]["messages"]
    assert [m["content"] for m in history] == [f"m{i}" for i in range(3, 11)]
    assert system["content"].index("A (https://s/notes/a.html) — h:\na words") < system["content"].index(params.related_intro) < system["content"].index("B (https://s/notes/b.html) — h (shares tags: x):\nb words")
    assert got[2]["sources_json"] == '{"sources":[]}' and [tuple(m) for m in got[2]["messages"]] == [("system", "S"), ("user", "hi")]


def test_parameters_are_checked():
    for bad in (lambda: Ranking(top_k=-1), lambda: Ranking(rrf_k=0), lambda: Ranking(lexical_weight=-1), lambda: Chunking(max_piece=0), lambda: Embedding(dim=0)):
        with pytest.raises(ValueError):
            bad()
    assert Ranking(top_k=30).depth == 30 and Ranking().depth == 24
