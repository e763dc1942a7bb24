"""Column functions over note files: front matter, defaults, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_jobs.functions.text import strip

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
ENTRIES = "array<struct<key:string,value:string>>"


def _wrong(what: str, source: Column | None, kind: str) -> Column:
    """An error of a column's type, which names the file where that is known."""
    return F.raise_error(F.lit(what) if source is None else F.concat(source, F.lit(": "), F.lit(what))).cast(kind)


def split_front_matter(raw: Column, source: Column | None = None) -> Column:
    """(front, body): what is between the first two ``---``, and the stripped rest; an error where the file has none."""
    parts = F.split(raw, "---", 3)
    good = raw.startswith("---\n") & (F.size(parts) == 3)
    return F.when(good, F.struct(F.get(parts, F.lit(1)).alias("front"), strip(F.get(parts, F.lit(2))).alias("body"))).otherwise(
        _wrong("a note file must start with front matter between two '---'", source, "struct<front:string,body:string>")
    )


def front_matter_map(front: Column, source: Column | None = None) -> Column:
    """Entries (key, value) of the header's lines, in order; blank lines are skipped, a line without a colon is an error."""
    lines = F.filter(F.split(front, _LINE_END), lambda line: strip(line) != "")

    def entry(line: Column) -> Column:
        at = F.instr(line, ":")
        good = F.struct(strip(F.substr(line, F.lit(1), at - 1)).alias("key"), strip(F.substr(line, at + 1)).alias("value"))
        said = F.concat(F.lit("no colon in the front matter line: "), line)
        return F.when(at > 0, good).otherwise(F.raise_error(said if source is None else F.concat(source, F.lit(": "), said)).cast("struct<key:string,value:string>"))

    return F.transform(lines, entry)


def value_of(entries: Column, key: str) -> Column:
    """The last value of a key; null where the key is absent."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def note_defaults(entries: Column, source: Column | None = None) -> dict[str, Column]:
    """The text columns of a note; a default stands in where a key is absent, not where it is empty. A title must be there."""
    def of(key: str, default: Column) -> Column:
        return F.coalesce(value_of(entries, key), default)

    title = of("title", _wrong("a note must have a title", source, "string"))
    return {
        "title": title,
        "heading": of("heading", title),
        "list_title": of("listTitle", title),
        "description": value_of(entries, "description"),
        "lang": of("lang", F.lit("en")),
        "category": of("category", F.lit("Notes")),
        "date": of("date", F.lit("")),
        "date_text": of("dateText", F.lit("")),
    }


def published_flag(entries: Column) -> Column:
    """False only where the value says so."""
    return F.lower(F.coalesce(value_of(entries, "published"), F.lit("true"))) != "false"


def slug_from_path(path: Column, root: str) -> Column:
    """The path below ``root`` without its last suffix."""
    base = root.rstrip("/") + "/"
    at = F.locate(base, path)
    below = F.when(at > 0, F.substr(path, at + len(base))).otherwise(path)
    return F.regexp_replace(below, r"(?<=[^/])\.[^./]+\z", "")


def url_from_slug(slug: Column) -> Column:
    return F.concat(F.lit("/notes/"), slug, F.lit(".html"))
