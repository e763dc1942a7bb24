import hashlib

import pytest
from pyspark.sql import functions as F

from corpus_jobs.llm import common, warc

TRAP = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 300
PAGES = [
    (1, "http://a/é", "x" * 1200), (2, "u\r\nWARC/1.1\r\nv", "x" * 1200), (9, None, "x" * 1200), (3, "", TRAP), (4, "u", TRAP), (5, "u", None), (6, "u", ""),
    (7, "u", "short"), (8, "u", "short"), (10, "u", "日本語" * 9000), (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "u", "WARC/1.1\r\n"), (13, "u", "WARC/1.1\r\n"), (None, "u", "x" * 1200), (9, None, "x" * 1200),
]


def written(spark, pages, **options):
    path = common.shared_dir(spark, "warc")
    warc.write(spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, payload string, total int").repartition(2), path, **options)
    return path


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_round_trip(spark, broadcast_bytes):
    path = written(spark, PAGES, broadcast_bytes=broadcast_bytes)
    found = warc.read(spark, path).collect()
    assert len(found) == len(PAGES)
    by_id = {r["id"]: r for r in found}
    assert len(by_id) == len(PAGES)
    got = []
    for r in found:
        whole = by_id[r["refers"]] if r["refers"] else r
        assert hashlib.sha1(whole["payload"]).hexdigest() == r["digest"]
        got.append((r["page_id"], bytes(whole["payload"]).decode()))
    assert sorted(got, key=str) == sorted(((i, h or "") for i, _, h in PAGES), key=str)
    again = [(r["page_id"], by_id[r["refers"]]["page_id"]) for r in found if r["record_type"] == "revisit"]
    assert sorted(again, key=str) == sorted([(1, 9), (2, 9), (None, 9), (9, 9), (3, 4)], key=str)


def test_very_long_payloads(spark):
    pages = [(1, "u", "é<p>" * 600_000), (2, "u", "é<p>" * 600_000), (3, "u", "WARC/1.1\r\n" * 50_000)]
    got = {r["page_id"]: r for r in warc.read(spark, written(spark, pages)).collect()}
    assert [got[i]["record_type"] for i in (1, 2, 3)] == ["revisit", "response", "response"]
    assert all(bytes(got[i]["payload"]).decode() == text for i, _, text in pages[1:])


def test_version_at_the_end_of_payloads_chunks_and_segments(spark):
    version = "WARC/1.1"
    ends = [version, "z" * 1500 + version, "z" * (4096 - len(version)) + version + "z" * 100, version * 700]
    # a block's segment ends at 8192 bytes, somewhere behind the HTTP header and the framing
    ends += ["z" * n + version + "z" * 3000 for n in range(8040, 8200)]
    pages = [(i, "u", text) for i, text in enumerate(ends)]
    urls = ["u/WARC/1.1", "u/WARC/1.1 ", "u/WARC/1.1  ", "WARC/1.1 u", "u "]
    pages += [(1000 + i, url, "text") for i, url in enumerate(urls)]
    path = written(spark, pages)
    assert [r["url"] for r in warc.read(spark, path).where("page_id >= 1000").orderBy("page_id").collect()] == urls
    got = {r["page_id"]: r["payload"] for r in warc.read(spark, path).collect()}
    assert [i for i, _, text in pages if got[i] is None or bytes(got[i]).decode() != text] == []
    blocks = [bytes(r["block"]) for r in warc.read_records(spark, path).collect()]
    assert len(blocks) > len(pages) and not any(version.encode() in b for b in blocks)


def test_files_are_plain_warc(spark):
    raw = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(written(spark, PAGES[:4])).collect())
    at = records = 0
    while at < len(raw):
        head = raw[at : raw.index(b"\r\n\r\n", at)].decode()
        assert head.startswith("WARC/1.1\r\nWARC-Type: ")
        size = int(dict(line.split(": ", 1) for line in head.split("\r\n")[1:])["Content-Length"])
        at += len(head.encode()) + 4 + size
        assert raw[at : at + 4] == b"\r\n\r\n"
        at, records = at + 4, records + 1
    assert records > 4


def test_lost_and_repeated_segments_show(spark):
    records = warc.read_records(spark, written(spark, [(1, "u", "x" * 30_000), (2, "u", "y" * 30_000)])).cache()
    assert warc.reassemble(records.where("coalesce(number, 0) != 2")).where("whole").count() == 0
    assert warc.reassemble(records.where("total IS NULL")).where("whole").count() == 0
    assert warc.reassemble(records.unionByName(records)).where("whole").count() == 0
    assert warc.reassemble(records.orderBy(F.desc("number"))).where("whole").count() == 2


def test_chunked_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.decode_http(head + b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    assert warc.decode_http(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    for broken in (b"", b"3\r\nabc\r\n", b"4\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"-1\r\n\r\n"):
        assert warc.decode_http(head + broken) is None
    assert warc.decode_http(b"no head") is None


def test_empty_table(spark):
    path = common.shared_dir(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0
