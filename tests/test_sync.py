import uuid

import pytest
from pyspark.sql import functions as F

from corpus_jobs.operators import sync
from corpus_jobs.operators.embed import embed_once, embed_texts, hashing_embedder
from corpus_jobs.params import Embedding
from corpus_jobs.plans import jobs
from corpus_jobs.schemas import CHUNKS, NOTES
from corpus_jobs.sources import tables


def day(month):
    return F.lit(f"2024-0{month}-01 00:00:00").cast("timestamp")


def files(spark, **bodies):
    return spark.createDataFrame([(f"/r/{k}.html", f"---\ntitle: {k}\n---\n{v}") for k, v in bodies.items()], "path string, raw string")


def test_sync_notes(spark):
    empty = spark.createDataFrame([], NOTES)
    first, count = jobs.sync_notes(files(spark, a="1", b="2"), "/r", empty, day(1))
    assert count.first()["seeded"] == 2 and first.schema.fieldNames() == NOTES.fieldNames()
    second, _ = jobs.sync_notes(files(spark, a="1", c="3"), "/r", first, day(2))
    got = {r["slug"]: (r["content_html"], r["created_at"].month, r["updated_at"].month) for r in second.collect()}
    assert got == {"a": ("1", 1, 2), "c": ("3", 2, 2)}


def test_deletes(spark):
    stored = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0)], "slug string, chunk_index int")
    keep = spark.createDataFrame([("a",)], "slug string")
    assert sync.delete_stale_chunk_slugs(stored, keep).count() == 3
    assert sync.delete_stale_notes(stored, keep.where("false")).count() == 0
    with pytest.raises(ValueError):
        sync.delete_stale_notes(stored, keep.where("false"), allow_empty=False)
    counts = spark.createDataFrame([("a", 1)], "slug string, n long")
    assert sorted(tuple(r) for r in sync.delete_chunk_tail(stored, counts).collect()) == [("a", 0), ("b", 0)]


def test_changes_and_upsert(spark):
    stored = spark.createDataFrame([("a", 0, "h", "old"), ("a", 1, None, "none"), ("z", 0, "h", "kept")], "slug string, chunk_index int, content_hash string, text string").withColumn("updated_at", day(1))
    new = spark.createDataFrame([("a", 0, "h", "x"), ("a", 1, "h", "y"), ("b", 0, "h", "w")], "slug string, chunk_index int, content_hash string, text string")
    changes = sync.changed_chunks(new, stored)
    assert {(r["slug"], r["chunk_index"]): r["is_changed"] for r in changes.collect()} == {("a", 0): False, ("a", 1): True, ("b", 0): True}
    assert tuple(sync.sync_counts(changes).first()) == (2, 1)
    out = sync.upsert_chunks(stored, changes.where("is_changed").drop("is_changed"), day(2))
    got = {(r["slug"], r["chunk_index"]): (r["text"], r["updated_at"].month) for r in out.collect()}
    assert got == {("a", 0): ("old", 1), ("a", 1): ("y", 2), ("b", 0): ("w", 2), ("z", 0): ("kept", 1)}


def scans(df):
    """(tables that are read, those of them whose rows go through a shuffle), by the scans of a plan and those below an exchange."""
    every, found, nodes = set(), set(), [(df._jdf.queryExecution().executedPlan(), False)]
    while nodes:
        node, below = nodes.pop()
        name = node.nodeName()
        if name.startswith("Scan"):
            every.add(name.split(".")[-1])
            found |= {name.split(".")[-1]} if below else set()
        nodes += [(node.children().apply(i), below or name == "Exchange") for i in range(node.children().size())]
    return every, found


def test_a_bucketed_table_is_not_shuffled(spark):
    rows = [(f"s{i % 40}", i // 40, f"h{i}", [float(i)], f"t{i}") for i in range(200)]
    schema = "slug string, chunk_index int, content_hash string, embedding array<float>, text string"
    plain = spark.createDataFrame(rows, schema).withColumn("updated_at", day(1))
    name = f"stored_{uuid.uuid4().hex}"
    stored = tables.save_bucketed(plain, name)
    new = spark.createDataFrame([(s, i, h if int(h[1:]) % 3 else "other", e, "new") for s, i, h, e, _ in rows[::2]] + [("s99", 0, "h", [1.0], "new")], schema)
    before = {conf: spark.conf.get(conf) for conf in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        changes = sync.changed_chunks(new, stored)
        out = sync.upsert_chunks(stored, changes.where("is_changed").drop("is_changed"), day(2))
        for df, other in ((changes, sync.changed_chunks(new, plain)), (out, sync.upsert_chunks(plain, changes.where("is_changed").drop("is_changed"), day(2)))):
            every, shuffled = scans(df)
            assert name in every and name not in shuffled
            assert sorted(map(str, df.collect())) == sorted(map(str, other.collect())) and df.count() > 100
    finally:
        for conf, value in before.items():
            spark.conf.set(conf, value)
        spark.sql(f"DROP TABLE {name}")


def notes(spark, **bodies):
    return spark.createDataFrame([(k, k.upper(), "H", v, k != "draft") for k, v in bodies.items()], "slug string, title string, heading string, content_html string, published boolean")


def test_sync_chunks_embeds_only_what_changed(spark):
    load, params = hashing_embedder(16), Embedding("m", 16)
    empty = spark.createDataFrame([], CHUNKS)
    big = "\n".join(f"<p>{'x' * 900} {i}</p>" for i in range(6))
    one, counts = jobs.sync_chunks(notes(spark, a=big, b="<p>small</p>", draft="<p>no</p>"), empty, load, day(1), params)
    n = one.count()
    assert tuple(counts.first()) == (n, 0) and n > 3
    one = spark.createDataFrame(one.collect(), CHUNKS)
    same, counts = jobs.sync_chunks(notes(spark, a=big, b="<p>small</p>"), one, load, day(2), params)
    assert tuple(counts.first()) == (0, n) and sorted(map(tuple, same.collect())) == sorted(map(tuple, one.collect()))
    less, counts = jobs.sync_chunks(notes(spark, a="<p>short</p>", b="<p>small</p>"), one, load, day(2), params)
    assert tuple(counts.first()) == (1, 1) and {(r["slug"], r["updated_at"].month) for r in less.collect()} == {("a", 2), ("b", 1)}
    other, counts = jobs.sync_chunks(notes(spark, b="<p>small</p>"), one, hashing_embedder(8), day(2), Embedding("m", 8))
    assert tuple(counts.first()) == (1, 0) and len(other.first()["embedding"]) == 8


def counting(path, dim=16, fails=()):
    """The test embedder; it notes every text that it gets in a file, and fails for some."""
    inner = hashing_embedder(dim)

    def load():
        embed = inner()

        def counted(texts, kind):
            with open(path, "a") as f:
                f.writelines(t.encode().hex() + "\n" for t in texts)
            if any(t in fails for t in texts):
                raise RuntimeError("the model is gone")
            return embed(texts, kind)

        return counted

    return load


def calls(path):
    got = path.read_text().split("\n")[:-1] if path.exists() else []
    if path.exists():
        path.write_text("")
    return sorted(bytes.fromhex(x).decode() for x in got)


def test_unchanged_notes_are_neither_parsed_nor_embedded(spark, tmp_path, monkeypatch):
    parsed = []
    monkeypatch.setattr(jobs, "chunk_notes", lambda rows, params, chunk=jobs.chunk_notes: parsed.append(sorted(r[0] for r in rows.select("slug").collect())) or chunk(rows, params))
    log, params = tmp_path / "calls", Embedding("m", 16)
    load = counting(log)

    def sync(bodies, snapshot, known, month, model=params):
        path = str(tmp_path / f"chunks{month}")
        stored = tables.read_table(spark, snapshot, CHUNKS) if snapshot else spark.createDataFrame([], CHUNKS)
        stats = tables.chunk_stats(spark, snapshot) if snapshot else None
        out, counts, digests = jobs.sync_changed_notes(notes(spark, **bodies), stored, known, load, day(month), model, stats=stats)
        tables.write_chunks(out, path)
        return path, tuple(counts.first()), spark.createDataFrame(digests.collect(), jobs.DIGESTS)

    def rows(path):
        return {(r["slug"], r["chunk_index"]): (r["updated_at"].month, len(r["embedding"])) for r in spark.read.parquet(path).collect()}

    big = "\n".join(f"<p>{'x' * 900} {i}</p>" for i in range(6))
    bodies = {"a": big, "b": "<p>small</p>", "same": "<p>small</p>", "void": "", "draft": "<p>no</p>"}
    first, counts, known = sync(bodies, None, spark.createDataFrame([], jobs.DIGESTS), 1)
    n = len(rows(first))
    assert parsed.pop() == ["a", "b", "same", "void"] and counts == (n, 0) and len(calls(log)) == n
    assert tables.chunk_stats(spark, first).collect() == [(n, 16, 16)]
    # nothing changed: nothing is parsed, nothing goes to the model, all rows stay
    second, counts, known = sync(bodies, first, known, 2)
    assert parsed.pop() == [] and counts == (0, n) and calls(log) == [] and rows(second) == rows(first)
    # one note shorter, one gone, one new: only these are parsed, their tails and rows go
    third, counts, known = sync({"a": "<p>short</p>", "b": "<p>small</p>", "void": "", "new": "<p>more</p>"}, second, known, 3)
    assert parsed.pop() == ["a", "new"] and counts == (2, 1) and len(calls(log)) == 2
    assert rows(third) == {("a", 0): (3, 16), ("b", 0): (1, 16), ("new", 0): (3, 16)}
    # a stored chunk is lost: its note is parsed again, though the digest is known
    lost = str(tmp_path / "lost")
    tables.write_chunks(spark.read.parquet(third).where("slug != 'b'"), lost)
    fourth, counts, known = sync({"a": "<p>short</p>", "b": "<p>small</p>", "void": "", "new": "<p>more</p>"}, lost, known, 4)
    assert parsed.pop() == ["b"] and counts == (1, 2) and rows(fourth)["b", 0] == (4, 16)
    # another model: all over again
    calls(log)
    _, counts, _ = sync({"a": "<p>short</p>", "b": "<p>small</p>"}, fourth, known, 5, Embedding("other", 16))
    assert parsed.pop() == ["a", "b"] and counts == (2, 0) and len(calls(log)) == 2


def test_each_text_goes_to_the_model_once(spark, tmp_path):
    log, store = tmp_path / "calls", str(tmp_path / "vectors")
    df = spark.createDataFrame([(i, f"text {i % 10}", f"h{i % 10}", [9.0]) for i in range(200)] + [(200, None, "h0", None)], "i int, t string, h string, embedding array<float>").repartition(5)
    got = embed_once(df, "t", "h", counting(log), 16, store=store).collect()
    assert calls(log) == sorted(f"text {i}" for i in range(10)) and len(got) == 201
    want = {r["t"]: r["v"] for r in embed_texts(df.select("t").distinct(), "t", hashing_embedder(16), 16, out="v").collect()}
    assert all(r["embedding"] == want[r["t"]] for r in got)
    embed_once(df.withColumns({"t": F.concat("t", F.lit("!")), "h": F.when(F.col("i") % 2 == 0, F.col("h")).otherwise(F.concat("h", F.lit("x")))}), "t", "h", counting(log), 16, store=store).collect()
    assert len(calls(log)) == 5  # the hashes decide
    with pytest.raises(Exception, match="vector of 16 numbers instead of 8"):
        embed_once(df, "t", "h", counting(log), 8).collect()
    assert {len(r["embedding"]) for r in embed_once(df.where("t IS NOT NULL"), "t", "h", hashing_embedder(8), 8, store=store).collect()} == {8}
    assert embed_once(df.where("false"), "t", "h", counting(log), 16).count() == 0


def test_a_failed_job_keeps_what_is_finished(spark, tmp_path):
    log, store = tmp_path / "calls", str(tmp_path / "vectors")
    df = spark.createDataFrame([(f"text {i}", f"{i:03}") for i in range(100)], "t string, h string").coalesce(1)
    with pytest.raises(Exception, match="the model is gone"):
        embed_once(df, "t", "h", counting(log, fails={"text 57"}), 16, store=store, batch_size=5, texts_a_file=10)
    first = calls(log)
    finished = {r["h"] for r in spark.read.parquet(store).collect()}
    assert finished and len(finished) % 10 == 0 and len(finished) < 100
    assert embed_once(df, "t", "h", counting(log), 16, store=store, batch_size=5, texts_a_file=10).count() == 100
    again = calls(log)
    assert sorted(again) == sorted(f"text {i}" for i in range(100) if f"{i:03}" not in finished) and len(first) < 100


def test_sizes_are_observed_or_read(spark, tmp_path):
    row = ("a", 0, "h", "t", "x", [1.0, 2.0], None)
    stored = spark.createDataFrame([row, ("b", 0, "h", "t", "x", None, None)], CHUNKS)
    tables.write_chunks(stored, str(tmp_path / "one"))
    stats = tables.chunk_stats(spark, str(tmp_path / "one"))
    assert tuple(stats.first()) == (2, 2, 2)
    assert [jobs.check_embedding_dim(stored, n, s).count() for n in (2, 3) for s in (None, stats, stats.where("false"))] == [2, 2, 2, 0, 0, 0]
    tables.write_chunks(stored.where("false"), str(tmp_path / "none"))
    assert jobs.check_embedding_dim(stored.where("false"), 3, tables.chunk_stats(spark, str(tmp_path / "none"))).count() == 0
    assert tables.chunk_stats(spark, str(tmp_path / "never")).count() == 0


def test_embedder_is_batched_and_checked(spark):
    df = spark.createDataFrame([(i, "t" * i if i else None) for i in range(70)], "i int, t string")

    def load():
        def embed(texts, kind):
            assert len(texts) <= 32 and kind == "query"
            return [[float(len(t)), 0.0] for t in texts]

        return embed

    got = {r["i"]: r["embedding"] for r in embed_texts(df, "t", load, 2, "query").collect()}
    assert got[0] is None and all(got[i] == [float(i), 0.0] for i in range(1, 70))
    with pytest.raises(Exception, match="vector of 2 numbers instead of 3"):
        embed_texts(df, "t", load, 3, "query").collect()
    with pytest.raises(ValueError):
        embed_texts(df, "t", load, 2, "other")
    assert embed_texts(df.where("false"), "t", load, 2).count() == 0


def test_the_test_embedder_against_plain_python(spark):
    import numpy as np
    from xxhash import xxh64_intdigest

    texts = ["a b a C", "", "one", "b a", "é é é x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in embed_texts(df, "t", hashing_embedder(8), 8).collect():
        v = [0.0] * 8
        for word in texts[r["i"]].lower().split():
            h = xxh64_intdigest(word.encode())
            v[h % 8] += 1 if h >= 1 << 63 else -1
        v[0] += not any(v)
        assert r["embedding"] == pytest.approx((np.array(v) / np.linalg.norm(v)).tolist(), abs=1e-6)
