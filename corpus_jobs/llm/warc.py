"""WARC archives: written as text files whose line separator ends a record, read back split at the version line.

Records longer than a segment continue in further records, which reading groups by their origin, orders by segment
number and verifies against the total length. Payloads are framed in chunks; a chunk ends inside every WARC/1.1 that a
payload holds, so no block holds one, whatever line ends the framing or the gap behind a segment put after it. In these
archives a version line therefore always starts a record, and files can be read in splits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_jobs.llm.common import let, materialise, with_locator
from corpus_jobs.operators.bitmaps import split_rows

_VERSION, _GAP = "WARC/1.1\r\n", "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _chunked(payload: Column, chunk: int) -> Column:
    """Chunked transfer framing of a text, as text."""
    def framed(part: Column) -> Column:
        return F.concat(F.lower(F.hex(F.octet_length(part))), F.lit("\r\n"), part.cast("string"), F.lit("\r\n"))

    def cut(text: Column) -> Column:
        return let(text.cast("binary"), lambda b: F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length(b) / chunk).cast("int") - 1), lambda i: framed(F.substring(b, i * chunk + 1, F.lit(chunk)))))

    parts = F.flatten(F.transform(F.filter(F.split(payload, r"(?<=WARC/)(?=1\.1)"), lambda x: x != ""), cut))
    return F.concat(F.array_join(parts, ""), F.lit("0\r\n\r\n"))


def _urn(locator: Column) -> Column:
    """A record's identifier, from its row's place: the same in every attempt, and each row's own."""
    h = F.md5(F.concat_ws("#", locator["file"], locator["row"].cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines after the version line; fields with a null value are left out."""
    return F.concat_ws("", *(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, segment: int = 8192, chunk: int = 4096, date: str = "1970-01-01T00:00:00Z", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The records of all pages, a row each: value.

    Of pages with equal payloads of ``least`` bytes or more, the one with the largest id (null: smallest; then the last
    in the files) is written whole, and the others as revisits of it. A null html is an empty payload, a null url is
    left out, line ends in a url are escaped. Repeated rows are pages of their own, revisits of the last of them. An
    empty table gives no records; other columns aren't read. Which rows are revisits is found and written first, without
    payloads, and told where rows are read (see bitmaps.split_rows), however many they are; of these rows the payload's
    digest alone is shuffled.
    """
    located = with_locator(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    rows = located.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), "_locator")
    keys = rows.select("page_id", F.sha2(F.col("payload").cast("binary"), 256).alias("equal"), F.octet_length("payload").alias("bytes"), "_locator").where(F.col("bytes") >= least)
    groups = keys.groupBy("equal").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "_locator")).alias("kept")).where("n > 1")
    revisits = keys.join(groups, "equal").where(F.col("_locator") != F.col("kept._locator"))
    revisits = revisits.select("_locator", _urn(F.col("kept._locator")).alias("refers"))
    revisits = materialise(revisits, "revisits")
    sha1 = F.sha1(F.col("payload").cast("binary")).alias("sha1")
    again, whole = split_rows(rows, "_locator", revisits, broadcast_bytes)
    again = again.select("page_id", "url", sha1, "_locator").join(revisits, "_locator").withColumn("block", F.lit(_HTTP + "\r\n"))
    block = F.concat(F.lit(_HTTP + "Transfer-Encoding: chunked\r\n\r\n"), _chunked(F.col("payload"), chunk))
    whole = whole.select("page_id", "url", sha1, "_locator", F.lit(None).cast("string").alias("refers"), block.alias("block"))
    rows = whole.unionByName(again).select("page_id", "url", "refers", _urn(F.col("_locator")).alias("id"), "sha1", F.col("block").cast("binary").alias("block"))
    total = F.octet_length("block")
    rows = rows.withColumns({"total": total, "segments": F.ceil(total / segment).cast("int")})
    parts = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("segments"))).alias("k"))
    k, many = F.col("k"), F.col("segments") > 1
    piece = F.substring(F.col("block"), (k - 1) * segment + 1, F.lit(segment))
    first = k == 1
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    uri = F.regexp_replace(uri, r"WARC/1\.1 *\z", "$0 ")  # or the line's end would make it a version line
    own = F.when(first, F.col("id")).otherwise(F.concat(F.substring("id", 1, 46), F.lit("/"), k.cast("string"), F.lit(">")))
    header = _header(
        ("WARC-Type", F.when(~first, F.lit("continuation")).when(F.col("refers").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        ("WARC-Record-ID", own),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", uri),
        ("Page-ID", F.when(first, F.col("page_id").cast("string"))),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "sha1"))),
        ("WARC-Profile", F.when(F.col("refers").isNotNull(), F.lit(_PROFILE))),
        ("WARC-Refers-To", F.col("refers")),
        ("WARC-Segment-Number", F.when(many, k.cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(~first, F.col("id"))),
        ("WARC-Segment-Total-Length", F.when(many & (k == F.col("segments")), F.col("total").cast("string"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(piece).cast("string")),
    )
    return parts.select(F.concat(F.lit(_VERSION), header, F.lit("\r\n"), piece.cast("string")).alias("value"))


def write(pages: DataFrame, path: str, **options) -> None:
    """Write the records of ``pages`` as WARC files below ``path`` (see records); an empty table gives files without records."""
    records(pages, **options).write.option("lineSep", _GAP).text(path)


def _field(name: str) -> Column:
    found = F.regexp_extract(F.concat(F.lit("\n"), "header", F.lit("\r\n")), rf"(?i)\n{name}:[ \t]*(.*?)\r\n", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``: type, id, url, page, digest, refers, origin, number, total, block, intact.

    A record is not intact where its block isn't as long as it says, as in a cut-off file.
    """
    lines = spark.read.option("lineSep", _VERSION).text(path).where(F.octet_length("value") > 0)
    at = F.octet_length("header") + 5
    rows = lines.withColumn("header", F.substring_index("value", _GAP, 1)).withColumn("length", _field("Content-Length").cast("int"))
    fields = {"type": "WARC-Type", "id": "WARC-Record-ID", "url": "WARC-Target-URI", "page": "Page-ID", "digest": "WARC-Payload-Digest", "refers": "WARC-Refers-To", "origin": "WARC-Segment-Origin-ID"}
    columns = {column: _field(name) for column, name in fields.items()}
    columns["url"] = F.regexp_replace(columns["url"], r"(WARC/1\.1 *) \z", "$1")
    return rows.select(
        *(value.alias(column) for column, value in columns.items()),
        _field("WARC-Segment-Number").cast("int").alias("number"),
        _field("WARC-Segment-Total-Length").cast("long").alias("total"),
        F.substring(F.col("value").cast("binary"), at, F.col("length")).alias("block"),
        F.coalesce(F.octet_length("value") == F.octet_length("header") + F.col("length") + 8, F.lit(False)).alias("intact"),
    )


def reassemble(found: DataFrame) -> DataFrame:
    """Whole records: continuations are put behind their origin's first segment by number; ``whole`` tells if all is there.

    Only segmented records are shuffled. A missing, repeated or cut segment, or a total length that differs, makes a
    record not whole.
    """
    alone = found.where("number IS NULL").select("type", "id", "url", "page", "digest", "refers", "block", F.col("intact").alias("whole"))
    parts = found.where("number IS NOT NULL").withColumn("key", F.coalesce("origin", "id"))
    part = F.struct("number", "block", "intact", "type", "url", "page", "digest", "refers", "total")
    joined = parts.groupBy("key").agg(F.sort_array(F.collect_list(part)).alias("s"))

    def whole(s: Column) -> Column:
        in_order = F.forall(F.transform(s, lambda x, i: (x["number"] == i + 1) & x["intact"]), lambda ok: ok)
        length = F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
        return F.coalesce(in_order & (F.element_at(s, -1)["total"] == length), F.lit(False))

    head = F.get("s", F.lit(0))
    block = F.array_join(F.transform("s", lambda x: x["block"].cast("string")), "").cast("binary")
    again = joined.select(head["type"].alias("type"), F.col("key").alias("id"), head["url"].alias("url"), head["page"].alias("page"), head["digest"].alias("digest"), head["refers"].alias("refers"), block.alias("block"), whole(F.col("s")).alias("whole"))
    return alone.unionByName(again)


def decode_http(block: bytes) -> bytes | None:
    """The body of an HTTP response, out of its chunked framing if it says so; None where the framing is broken."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    if b"\r\ntransfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or len(body) < end + 4 + size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits below ``path``: id, page_id, url, record_type, digest, refers, payload.

    The payload is null for revisits, and where a record isn't whole, its framing is broken or its digest differs. Archives
    without records give no rows, records that are there twice come twice.
    """
    whole = reassemble(read_records(spark, path)).where(F.col("type").isin("response", "revisit"))

    @F.pandas_udf("binary")
    def decoded(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: None if b is None else decode_http(bytes(b)))

    rows = whole.withColumn("payload", decoded(F.when(F.col("whole") & (F.col("type") == "response"), F.col("block"))))
    good = F.concat(F.lit("sha1:"), F.sha1("payload")) == F.col("digest")
    return rows.select("id", F.col("page").cast("long").alias("page_id"), "url", F.col("type").alias("record_type"), F.substring("digest", 6, 40).alias("digest"), "refers", F.when(good, F.col("payload")).alias("payload"))
