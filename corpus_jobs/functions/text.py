"""Column functions over texts: white space, tokens, hashes, excerpts."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a regular expression's character class.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Its characters but the line feed and the space.
_ODD = "".join(map(chr, (0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Characters whose case folding has ASCII letters and differs from their lower case.
_FOLDED = "ßſŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ"
TOKEN = r"[a-z0-9]+(?:[._:/-][a-z0-9]+)*"
#: By byte: 1 for what makes tokens, 2 for what may stand inside one.
_KIND = np.array([1 if chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789" else 2 if chr(i) in "._:/-" else 0 for i in range(256)], np.uint8)


def collapse(c: Column) -> Column:
    """Runs of white space become one space, and none is left at either end."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def strip(c: Column) -> Column:
    """White space at either end goes."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def normalize_text(c: Column) -> Column:
    """Every line collapsed; empty lines go. Only what is to change is matched, so most texts are just looked through."""
    def changed(t: Column, parts: list[str], pattern: str, by: str) -> Column:
        # looking for bytes is much faster than a pattern, which few texts need
        return F.when(functools.reduce(operator.or_, (t.contains(part) for part in parts)), F.regexp_replace(t, pattern, by)).otherwise(t)

    lines = let(F.translate(c, _ODD, " " * len(_ODD)), lambda t: changed(t, ["  "], "  +", " "))
    return F.btrim(let(lines, lambda t: changed(t, [" \n", "\n ", "\n\n"], r" \n[ \n]*|\n[ \n]+", "\n")), F.lit(" \n"))


def normalize_tags(c: Column) -> Column:
    """Comma-separated tags as an array: lower case, hyphens for white space, without empty or repeated ones; null gives none."""
    hyphened = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.regexp_replace(F.lower(strip(t)), f"{SPACE}+", "-"))
    return F.array_distinct(F.filter(hyphened, lambda t: t != ""))


def canonical_slug(c: Column) -> Column:
    """A requested slug without one ``.html`` at its end."""
    return F.regexp_replace(c, r"\.html\z", "")


def casefold(c: Column) -> Column:
    """Case folding as far as ASCII letters can tell."""
    low = F.lower(c)
    folded = low
    for ch in _FOLDED:
        folded = F.replace(folded, F.lit(ch), F.lit(ch.casefold()))
    return F.when(F.translate(low, _FOLDED, "") != low, folded).otherwise(low)


def lexical_tokens(c: Column) -> Column:
    """Array of a text's tokens, repeats included; null gives none."""
    return F.regexp_extract_all(casefold(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, pa.Array]:
    """(row, token) of all tokens of a batch of texts, the same ones as by lexical_tokens."""
    parts = [(text or "").casefold().encode() for text in texts]
    found = np.frombuffer(b" ".join([*parts, b""]) or b" ", np.uint8)
    kind = _KIND[found]
    inside = kind == 1
    inside[1:-1] |= (kind[1:-1] == 2) & inside[:-2] & inside[2:]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    rows = np.searchsorted(np.cumsum([len(part) + 1 for part in parts]), starts, "right")
    return rows, pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(found[inside]))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf) of a token array, by runs of the sorted one; needs no shuffle."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda a, k: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - a).cast("long").alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs)).otherwise(none)


def lexical_document(title: Column, heading: Column, text: Column) -> Column:
    """The text that is indexed for a chunk."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(heading, F.lit("")), F.coalesce(text, F.lit("")))


def chunk_hash(text: Column, model: str) -> Column:
    """Fingerprint of a text for one embedding model."""
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), text), 256)


def source_url(url: Column, site: str) -> Column:
    return F.concat(F.lit(site), url)


def format_excerpts(title: Column, url: Column, heading: Column, text: Column, site: str, shared_tags: Column | None = None) -> Column:
    """One excerpt of a prompt; related ones name the tags they share."""
    head = F.concat(title, F.lit(" ("), source_url(url, site), F.lit(") — "), F.coalesce(heading, F.lit("None")))
    if shared_tags is not None:
        head = F.concat(head, F.lit(" (shares tags: "), F.array_join(shared_tags, ", "), F.lit(")"))
    return F.concat(head, F.lit(":\n"), text)
