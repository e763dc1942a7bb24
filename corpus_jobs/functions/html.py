"""HTML bodies as sections, parsed in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_jobs.schemas import SECTIONS

#: What starts a section, what breaks a line, what is never text.
HEADINGS = frozenset({"h2", "h3"})
BLOCKS = frozenset({"p", "li", "ul", "ol", "pre", "blockquote", "figure", "figcaption", "table", "tr"})
MUTED = frozenset({"script", "style"})


class _Tokens(HTMLParser):
    """Lists a document's tags and texts; what they mean is decided afterwards."""

    def __init__(self, html: str):
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append(("<", tag))

    def handle_endtag(self, tag):
        self.found.append((">", tag))

    def handle_data(self, data):
        self.found.append(("", data))


def _tidy(text: str) -> str:
    return "\n".join(line for line in (" ".join(raw.split()) for raw in text.split("\n")) if line)


def sections(html: str) -> list[tuple[str | None, str]]:
    """(heading, text) in order: a heading's end tag opens a section, with the last heading's text.

    Block tags break the line of the open section, also inside a heading; texts in script and style go. Sections with
    neither heading nor text go.
    """
    texts: list[str] = []
    titles: list[str | None] = []
    title, text, inside, muted = "", "", False, 0
    heading: str | None = None
    for kind, value in _Tokens(html).found:
        if not kind:
            if muted:
                continue
            if inside:
                title += value
            else:
                text += value
        elif value in MUTED:
            muted = muted + 1 if kind == "<" else max(0, muted - 1)
        elif value in BLOCKS:
            text += "\n"
        elif value in HEADINGS and kind == "<":
            inside, title = True, ""
        elif value in HEADINGS:
            titles.append(heading)
            texts.append(text)
            inside, heading, text = False, title.strip() or None, ""
    pairs = zip([*titles, heading], map(_tidy, [*texts, text]), strict=True)
    return [(h, t) for h, t in pairs if h or t]


def html_sections(html: Column) -> Column:
    """Array of (heading, text) of an HTML body; null gives none."""
    @F.pandas_udf(SECTIONS)
    def parsed(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda body: [{"heading": h, "text": t} for h, t in sections(body or "")])

    return parsed(html)
