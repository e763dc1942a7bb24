"""Sections to chunks: small ones merged, long ones split, a title put in front."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_jobs.functions.text import let, normalize_text

_SECTIONS = "array<struct<heading:string,text:string>>"


def merge_small_sections(sections: Column, least: int = 200) -> Column:
    """A section shorter than ``least`` goes to the end of the one before it, its heading as a line of its own.

    Whether a section is merged depends on its own length only, so the sections that stay are found first, and each is
    put together once with those behind it: the work is linear in the document.
    """
    def joined(group: Column) -> Column:
        head = F.get(group, F.lit(0))
        lines = F.flatten(F.transform(group, lambda x, i: F.when(i == 0, F.array(x["text"])).otherwise(F.array(F.coalesce(x["heading"], F.lit("")), x["text"]))))
        return F.struct(head["heading"].alias("heading"), F.when(F.size(group) == 1, head["text"]).otherwise(normalize_text(F.array_join(lines, "\n"))).alias("text"))

    def merged(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | F.coalesce(F.length(F.get(xs, i)["text"]) >= least, F.lit(True)))
        return let(starts, lambda ss: F.transform(ss, lambda s, k: let(F.slice(xs, s + 1, F.coalesce(F.get(ss, k + 1), F.size(xs)) - s), joined)))

    return F.when(F.size(sections) > 0, let(sections, merged)).otherwise(F.when(sections.isNotNull(), F.array().cast(_SECTIONS)))


def split_long_text(text: Column, most: int = 2500) -> Column:
    """Lines packed in order into pieces of at most ``most`` characters; a longer line is a piece of its own.

    The fold goes over the lines' lengths and gives where each piece starts and ends; an empty line at a piece's start goes.
    """
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("p"), F.lit(0).alias("a"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def closed(s: Column) -> Column:
        return F.concat(s["p"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("b"))))

    def fold(s: Column, line: Column) -> Column:
        size, empty = F.length(line), s["n"] == 0
        longer = F.when(empty, size).otherwise(s["n"] + 1 + size)
        full = ~empty & (longer > most)
        return F.struct(F.when(full, closed(s)).otherwise(s["p"]).alias("p"), F.when(full | empty, s["i"]).otherwise(s["a"]).alias("a"), F.when(full, size).otherwise(longer).alias("n"), (s["i"] + 1).alias("i"))

    def pieces(lines: Column) -> Column:
        places = F.aggregate(lines, start, fold, lambda s: F.when(s["n"] == 0, s["p"]).otherwise(closed(s)))
        return F.transform(places, lambda p: F.array_join(F.slice(lines, p["a"] + 1, p["b"] - p["a"]), "\n"))

    return F.when(F.length(text) <= most, F.array(text)).otherwise(let(F.split(text, "\n"), pieces))


def _packed(text: str, most: int) -> list[str]:
    pieces, held, size = [], [], 0
    for line in text.split("\n"):
        line = " ".join(line.split())  # its white space is text.SPACE
        if held and line and size + 1 + len(line) > most:
            pieces.append("\n".join(held))
            held = []
        if line:
            size = size + 1 + len(line) if held else len(line)
            held.append(line)
    return [*pieces, "\n".join(held)] if held else pieces


def pieces_of(texts: list[str | None], most: int = 2500) -> tuple[list[int], list[int], list[str]]:
    """(row, number, piece) of a batch of texts, the same pieces as by split_long_text of normalize_text; a text without words has none."""
    found = [(row, number, piece) for row, text in enumerate(texts) for number, piece in enumerate(_packed(text or "", most))]
    rows, numbers, pieces = zip(*found, strict=True) if found else ((), (), ())
    return list(rows), list(numbers), list(pieces)


def compose_chunks(sections: Column, title: Column, heading: Column, most: int = 2500) -> Column:
    """Array of (heading, text): every piece with title and heading in front; a section without heading takes the note's."""
    def composed(s: Column) -> Column:
        own = F.coalesce(F.nullif(s["heading"], F.lit("")), heading)
        return F.transform(split_long_text(s["text"], most), lambda piece: F.struct(own.alias("heading"), F.concat(title, F.lit(" — "), own, F.lit("\n\n"), piece).alias("text")))

    return F.flatten(F.transform(sections, composed))
