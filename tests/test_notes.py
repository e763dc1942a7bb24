import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpus_jobs.operators import notes
from corpus_jobs.plans import jobs
from corpus_jobs.schemas import NOTES, PARSED
from corpus_jobs.sources import codecs, tables
from corpus_jobs.sources import files as source_files
from corpus_jobs.sources.files import parse_notes, read_note_files

FULL = """---
title: A title: with colon
heading: Head
listTitle: List
description: a b
lang: de
category: Cat

date: 2024-01-05
dateText: 5 Jan
tags: Software Architecture, Trade-Offs , software-architecture
title: Last one wins
---

<p>Body --- with dashes</p>
"""


def parsed(spark, *raws):
    df = spark.createDataFrame([(f"/r/notes/dir/n{i}.v1.html", raw) for i, raw in enumerate(raws)], "path string, raw string")
    return parse_notes(df, "/r/notes").collect()


def test_files_are_found_and_parsed(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "one+a.html").write_bytes(b"---\r\ntitle: X\r\n---\r\nbody\r\n")
    (tmp_path / "two.txt").write_text("no")
    files = read_note_files(spark, str(tmp_path))
    (note,) = parse_notes(files, str(tmp_path)).collect()
    assert (note["slug"], note["url"], note["title"], note["content_html"]) == ("sub dir/one+a", "/notes/sub dir/one+a.html", "X", "body")


def test_no_file_is_overlooked(spark, tmp_path):
    names = ["a.html", "_b.html", ".d.html", "_drafts/c.html", ".hidden/deep/er/_x.y.html", "sub/a.html", "sub/A B%20c#?.html", "é/ü.html", "x.html/inner.html"]
    for name in [*names, "no.htm", "sub/b.HTML", "c.html.bak"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"---\ntitle: {name}\n---\n{name}")
    (tmp_path / "empty folder").mkdir()
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "link.html").symlink_to(tmp_path / "a.html")
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        files = read_note_files(spark, root)
        assert sorted(r["slug"] for r in parse_notes(files, root).collect()) == sorted(n.removesuffix(".html") for n in [*names, "link.html"])
    (tmp_path / "sub" / "_none.html").write_text("")
    with pytest.raises(PySparkException, match="_none.html: a note file must start"):
        jobs.sync_notes(read_note_files(spark, str(tmp_path)), str(tmp_path), spark.createDataFrame([], NOTES), F.current_timestamp())[0].collect()
    (tmp_path / "sub" / "_none.html").write_bytes(b"---\ntitle: \xff\n---\n")
    with pytest.raises(PySparkException, match="_none.html is not UTF-8"):
        read_note_files(spark, str(tmp_path)).collect()
    with pytest.raises(PySparkException, match="nowhere"):
        read_note_files(spark, f"{tmp_path}/nowhere").collect()
    assert read_note_files(spark, str(tmp_path / "empty folder")).count() == 0


def test_files_are_listed_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"d{i % 30}" / f"e{i % 60}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{i % 30}" / f"e{i % 60}" / f"{i}.html").write_text(f"---\ntitle: {i}\n---\n{i}")
    monkeypatch.setattr(source_files, "FILES_A_TASK", 20)
    found = read_note_files(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 15 and found.count() == 300


def test_front_matter(spark):
    (n,) = parsed(spark, FULL)
    assert n.asDict() == {
        "slug": "dir/n0.v1", "url": "/notes/dir/n0.v1.html", "title": "Last one wins", "heading": "Head", "list_title": "List", "description": "a b", "lang": "de", "category": "Cat",
        "date": "2024-01-05", "date_text": "5 Jan", "content_html": "<p>Body --- with dashes</p>", "published": True, "tags": ["software-architecture", "trade-offs"],
    }
    assert list(n.asDict()) == PARSED.fieldNames()


def test_defaults_stand_in_for_absent_keys_only(spark):
    bare, empty, draft = parsed(spark, "---\ntitle: T\n---\n", "---\ntitle: T\nheading:\nlang: \ndate:\n---\nx", "---\ntitle: T\npublished: FALSE\n---\nx")
    assert (bare["heading"], bare["list_title"], bare["description"], bare["lang"], bare["category"], bare["date"], bare["tags"], bare["published"]) == ("T", "T", None, "en", "Notes", "", [], True)
    assert (empty["heading"], empty["lang"], empty["date"]) == ("", "", "")
    assert not draft["published"]


@pytest.mark.parametrize("raw", ["title: T", "---\ntitle: T\n", "---\nno colon\n---\nx", "---\nlang: en\n---\nx", ""])
def test_broken_files_are_errors(spark, raw):
    with pytest.raises(PySparkException):
        parsed(spark, raw)


def rows(spark, *data):
    return spark.createDataFrame(data, "slug string, published boolean, date string, category string, title string, tags array<string>")


def test_visibility_and_listing(spark):
    df = rows(spark, ("a", True, "2024-01-02", "B", "t", ["x"]), ("draft", False, "2024-01-01", "A", "t", None), ("later", True, "2999-12-31", "A", "t", None), ("b", True, "2024-01-03", "B", "t", None), ("c", True, "", "A", "u", None))
    for name in ("url", "list_title", "description", "lang", "date_text", "heading", "content_html"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    assert [r["slug"] for r in notes.list_published_notes(df, "2024-06-01").collect()] == ["c", "b", "a"]
    assert "content_html" in notes.list_published_notes(df, "2024-06-01", include_content=True).columns
    assert {r["slug"] for r in notes.embeddable_notes(df).collect()} == {"a", "later", "b", "c"}
    asked = spark.createDataFrame([("a.html",), ("a",), ("draft",), ("none",)], "slug string")
    assert [r["slug"] for r in notes.get_published_notes(df, asked, "2024-06-01").collect()] == ["a"]
    assert {r["slug"]: r["tags"] for r in notes.published_tags(df, "2024-06-01").collect()} == {"a": ["x"], "b": [], "c": []}


def test_codecs_and_jdbc_rows(spark):
    df = spark.createDataFrame([(["a", 'b"c'], [0.5, -1.25], True), (None, None, False)], "tags array<string>, embedding array<float>, published boolean")
    sent = tables.jdbc_row(df)
    assert [tuple(r) for r in sent.collect()] == [('["a","b\\"c"]', "[0.5,-1.25]", 1), ("[]", None, 0)]
    assert [tuple(r) for r in tables.from_jdbc_row(sent).collect()] == [(["a", 'b"c'], [0.5, -1.25], True), ([], None, False)]
    texts = spark.createDataFrame([(None,), ("",), ('["x"]',)], "t string")
    assert [r["x"] for r in texts.select(codecs.decode_tags(F.col("t")).alias("x")).collect()] == [[], [], ["x"]]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "v1")
    assert tables.read_table(spark, path, NOTES).count() == 0
    tables.write_table(spark.range(3), path)
    assert tables.read_table(spark, path).count() == 3
    with pytest.raises(PySparkException):
        tables.write_table(spark.range(3), path)
