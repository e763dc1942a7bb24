import pytest
from pyspark.sql import functions as F

from corpus_jobs.functions import text
from corpus_jobs.functions.chunking import compose_chunks, merge_small_sections, pieces_of, split_long_text
from corpus_jobs.functions.html import sections
from corpus_jobs.operators.notes import chunk_notes


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("Software Architecture, Trade-Offs , software-architecture", ["software-architecture", "trade-offs"]), (None, []), ("", []), (" ,\u00a0,", []), ("A\t \u2003B", ["a-b"])])
def test_normalize_tags(spark, raw, want):
    assert one(spark, text.normalize_tags(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw", ["a  b \n\n  c\u00a0d \n", "", "\u2003x\x1cy\x85z\n\x0b\n.", "é\r\nf"])
def test_normalize_text(spark, raw):
    lines = [" ".join(line.split()) for line in raw.split("\n")]
    assert one(spark, text.normalize_text(F.lit(raw))) == "\n".join(line for line in lines if line)


def test_normalize_random_texts(spark):
    import random
    import re

    rng = random.Random(4)
    raws = ["".join(rng.choice("ab \n\t\r\x0b\x1c\x85\u00a0\u2003\u200b  ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, t string").select("t", text.normalize_text(F.col("t")).alias("n"))
    for r in df.collect():
        lines = [" ".join(line.split()) for line in r["t"].split("\n")]
        assert r["n"] == "\n".join(line for line in lines if line)


def test_every_space_character_is_stripped(spark):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert one(spark, text.strip(F.lit(spaces + "a b" + spaces))) == "a b"
    assert one(spark, text.collapse(F.lit(f"a{spaces}b"))) == "a b"


def test_tokens_follow_case_folding(spark):
    import re

    for raw in ("Straße App/v1.2:x-y café ﬁne ǅ", "İX K ſo ŉa ẚ", "a--b a-b- .c", ""):
        assert one(spark, text.lexical_tokens(F.lit(raw))) == re.findall(text.TOKEN, raw.casefold())
    folded = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c).casefold() and re.search("[a-z0-9]", chr(c).casefold())]
    df = spark.createDataFrame([(f"a{c}b",) for c in folded], "t string")
    assert all(r["k"] == re.findall(text.TOKEN, r["t"].casefold()) for r in df.select("t", text.lexical_tokens(F.col("t")).alias("k")).collect())


def test_slugs_hashes_excerpts(spark):
    import hashlib

    assert one(spark, text.canonical_slug(F.lit("a.html.html"))) == "a.html"
    assert one(spark, text.canonical_slug(F.lit("a.html\n"))) == "a.html\n"
    assert one(spark, text.chunk_hash(F.lit("é"), "m")) == hashlib.sha256("m\0é".encode()).hexdigest()
    assert one(spark, text.lexical_document(F.lit("T"), F.lit(None).cast("string"), F.lit("x"))) == "T  x"
    got = one(spark, text.format_excerpts(F.lit("T"), F.lit("/u"), F.lit("H"), F.lit("x"), "https://s", F.array(F.lit("a"), F.lit("b"))))
    assert got == "T (https://s/u) — H (shares tags: a, b):\nx"


def test_sections_at_headings():
    got = sections("<p>Intro</p><h2>Heartbeats</h2><p>One</p><p>Two</p><h3>Timeouts</h3><ul><li>x</li><li>y</li></ul>")
    assert got == [(None, "Intro"), ("Heartbeats", "One\nTwo"), ("Timeouts", "x\ny")]
    assert sections("<p>Visible</p><script>var x = '</p>';</script><style>p{}</style>") == [(None, "Visible")]


def test_section_quirks():
    assert sections("<h2>A</h2>x</h3>y") == [("A", "x"), ("A", "y")]
    assert sections("<h2>A<p>b</p> c</h2>") == [("A" + "b c", "")]
    assert sections("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == [(None, "ab\nc")]
    assert sections("a&nbsp;&amp;  b<br>c<!-- no -->") == [(None, "a & bc")]
    assert sections("") == [] and sections("<h2>open only") == []


def fold_sections(found, least=200):
    out = []
    for heading, body in found:
        if out and len(body) < least:
            lines = f"{out[-1][1]}\n{heading or ''}\n{body}".split("\n")
            out[-1] = (out[-1][0], "\n".join(x for x in lines if x))
        else:
            out.append((heading, body))
    return out


def fold_lines(body, most):
    pieces, now = [], None
    for line in body.split("\n"):
        if now is not None and len(now) + 1 + len(line) > most:
            pieces.append(now)
            now = line
        else:
            now = line if now is None else f"{now}\n{line}"
    return [*pieces, now]


def test_folds_against_plain_ones(spark):
    import random

    rng = random.Random(1)
    cases = []
    for _ in range(40):
        found = [(rng.choice([None, "H", "Head"]), "\n".join("w" * rng.randint(1, 90) for _ in range(rng.randint(1, 8)))) for _ in range(rng.randint(0, 6))]
        cases.append((found, "\n".join("é" * rng.randint(1, 120) for _ in range(rng.randint(1, 30)))))
    df = spark.createDataFrame(cases, "s array<struct<heading:string,text:string>>, t string")
    for (found, body), r in zip(cases, df.select(merge_small_sections(F.col("s")).alias("m"), split_long_text(F.col("t"), 300).alias("p")).collect(), strict=True):
        assert [(x["heading"], x["text"]) for x in r["m"]] == fold_sections(found)
        assert r["p"] == fold_lines(body, 300)


def test_many_lines_are_merged_and_split_in_linear_time(spark):
    import time

    lines = [f"line {i}" for i in range(100_000)]
    df = spark.createDataFrame([([("H", x) for x in lines], "\n".join(lines))], "s array<struct<heading:string,text:string>>, t string")
    start = time.time()
    r = df.select(merge_small_sections(F.col("s")).alias("m"), split_long_text(F.col("t")).alias("p")).first()
    assert time.time() - start < 30
    assert len(r["m"]) == 1 and r["m"][0]["text"] == lines[0] + "".join(f"\nH\n{x}" for x in lines[1:])
    assert "\n".join(r["p"]) == "\n".join(lines) and max(map(len, r["p"])) <= 2500


def test_empty_lines_at_the_start_of_pieces_go(spark):
    df = spark.createDataFrame([("\n\nab\n\ncd\n\n\nefgh",), ("\n" * 9,)], "t string")
    got = [r["p"] for r in df.select(split_long_text(F.col("t"), 6).alias("p")).collect()]
    assert got == [["ab\n\ncd", "efgh"], []]


def test_long_sections_are_split_with_their_prefix(spark):
    body = "\n".join("p" * 600 for _ in range(8))
    df = spark.createDataFrame([([("", body)],)], "s array<struct<heading:string,text:string>>")
    got = df.select(compose_chunks(F.col("s"), F.lit("T"), F.lit("Note")).alias("c")).first()["c"]
    assert len(got) > 1 and all(c["heading"] == "Note" and c["text"].startswith("T — Note\n\n") and len(c["text"]) <= 2500 + 10 for c in got)


def test_chunk_notes(spark):
    notes = spark.createDataFrame([("a", "T", "N", f"<h2>Main</h2><p>{'x' * 250}</p><h3>Small</h3><p>tail</p>"), ("b", "T", "N", None), ("c", "T", "N", "<h2>Only</h2>")], "slug string, title string, heading string, content_html string")
    got = {(r["slug"], r["chunk_index"]): r for r in chunk_notes(notes).collect()}
    assert set(got) == {("a", 0), ("c", 0)}
    assert got["a", 0]["text"] == "T — Main\n\n" + "x" * 250 + "\nSmall\ntail"
    assert got["c", 0]["text"] == "T — Only\n\n"


def test_tokens_of_batches_are_those_of_the_column():
    import random
    import re

    rng = random.Random(4)
    texts = [None, "", "...", "a", "-a.b-", "a..b", "Straße ŉ ﬀ/x_y:z", *("".join(rng.choices("ab1._:/- \nßÄéK\u0130", k=rng.randint(0, 40))) for _ in range(500))]
    rows, tokens = text.tokens_of(texts)
    found = [[] for _ in texts]
    for row, token in zip(rows.tolist(), tokens.to_pylist(), strict=True):
        found[row].append(token)
    assert found == [re.findall(text.TOKEN, (t or "").casefold()) for t in texts]
    assert [len(x) for x in text.tokens_of([])] == [0, 0]


def test_pieces_of_batches_are_those_of_the_column(spark):
    import random

    rng = random.Random(6)
    texts = [None, "", "\u2003\n \x1c", "x" * 50, "ab\n\n" * 9, *("".join(rng.choices("abé\n\n  \t\r\x0b\x1c\x85\u00a0\u2003\u2028\u200b", k=rng.randint(0, 60))) for _ in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.normalize_text(F.col("t")).alias("n")).where("n != ''")
    want = [tuple(r) for r in df.select("i", F.posexplode(split_long_text(F.col("n"), 12))).orderBy("i", "pos").collect()]
    assert list(zip(*pieces_of(texts, 12), strict=True)) == want
    assert pieces_of([]) == ([], [], [])
