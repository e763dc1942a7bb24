"""Which notes and chunks are visible, and listings of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_jobs.functions.chunking import compose_chunks, merge_small_sections
from corpus_jobs.functions.html import html_sections
from corpus_jobs.functions.text import canonical_slug
from corpus_jobs.params import Chunking

SUMMARY = ("slug", "url", "title", "list_title", "description", "lang", "category", "date", "date_text", "tags")


def visible_notes(notes: DataFrame, as_of: str) -> DataFrame:
    """Published notes dated ``as_of`` (ISO text) or before; an empty date is before any other."""
    return notes.where(F.col("published") & (F.col("date") <= F.lit(as_of)))


def embeddable_notes(notes: DataFrame) -> DataFrame:
    """Published notes, whatever their date: those to come are chunked and embedded ahead."""
    return notes.where("published")


def list_published_notes(notes: DataFrame, as_of: str, include_content: bool = False) -> DataFrame:
    """Visible notes by category, latest first, then by title; with heading and content if asked for."""
    columns = [*SUMMARY, "heading", "content_html"] if include_content else SUMMARY
    return visible_notes(notes, as_of).select(*columns).orderBy(F.asc("category"), F.desc("date"), F.asc("title"))


def get_published_notes(notes: DataFrame, slugs: DataFrame, as_of: str) -> DataFrame:
    """The visible notes that ``slugs`` (column slug, with or without ``.html``) asks for, each once."""
    asked = slugs.select(canonical_slug(F.col("slug")).alias("slug"))
    return visible_notes(notes, as_of).join(asked, "slug", "left_semi")


def published_tags(notes: DataFrame, as_of: str) -> DataFrame:
    """(slug, tags) of the visible notes; no tags give an empty array."""
    return visible_notes(notes, as_of).select("slug", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def visible_chunks(chunks: DataFrame, notes: DataFrame, as_of: str) -> DataFrame:
    """Chunks of visible notes, with the notes' title and url."""
    return chunks.join(visible_notes(notes, as_of).select("slug", "title", "url"), "slug")


def chunk_notes(notes: DataFrame, params: Chunking = Chunking()) -> DataFrame:
    """(slug, chunk_index, heading, text) of every note's HTML, in one narrow pass."""
    sections = notes.select("slug", "title", "heading", html_sections(F.col("content_html")).alias("s"))
    merged = sections.withColumn("s", merge_small_sections(F.col("s"), params.min_section))
    chunks = merged.select("slug", F.posexplode(compose_chunks(F.col("s"), F.col("title"), F.col("heading"), params.max_piece)).alias("chunk_index", "c"))
    return chunks.select("slug", "chunk_index", "c.heading", "c.text")
