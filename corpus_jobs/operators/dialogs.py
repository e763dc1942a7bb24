"""Conversations: which are valid, what they ask, and the prompt that answers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_jobs.functions.text import format_excerpts, source_url
from corpus_jobs.params import Dialogs


def validate_conversations(messages: DataFrame, params: Dialogs = Dialogs()) -> DataFrame:
    """(conv_id, is_valid, reason) of messages (conv_id, turn, role, text); the first rule broken is the reason."""
    rules = messages.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.bool_and(F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).alias("roles"),
        F.bool_and(F.length(F.coalesce("text", F.lit(""))).between(1, params.max_chars)).alias("sizes"),
        F.max_by("role", "turn").alias("last"),
    )
    reason = (
        F.when(F.col("n") > params.max_messages, "too many messages")
        .when(~F.col("roles"), "unknown role")
        .when(~F.col("sizes"), "empty or too long message")
        .when(~F.col("last").eqNullSafe(F.lit("user")), "last message is not from the user")
    )
    return rules.select("conv_id", reason.isNull().alias("is_valid"), reason.alias("reason"))


def query_from_conversation(messages: DataFrame) -> DataFrame:
    """(conv_id, query): the last message's text."""
    return messages.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))


def history_window(messages: DataFrame, n: int = 8) -> DataFrame:
    """The last n messages of every conversation, with their position in it from 1 on."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = messages.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")
    return last.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


def distinct_sources(hits: DataFrame, related: DataFrame, site: str = "") -> DataFrame:
    """(query_id, sources_json): hits (query_id, rank, slug, title, url), then related ones, each note once at its first place."""
    def listed(rows: DataFrame, part: int) -> DataFrame:
        return rows.select("query_id", F.lit(part).alias("part"), "rank", "slug", "title", "url")

    both = listed(hits, 0).unionByName(listed(related, 1))
    once = both.groupBy("query_id", "slug").agg(F.min(F.struct("part", "rank", "title", "url")).alias("s"))
    source = F.struct("slug", F.col("s.title").alias("title"), source_url(F.col("s.url"), site).alias("url"))
    rows = once.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("s.part", "s.rank", source.alias("source")))).alias("all"))
    return rows.select("query_id", F.to_json(F.struct(F.col("all.source").alias("sources"))).alias("sources_json"))


def _joined(rows: DataFrame, excerpt, name: str) -> DataFrame:
    """(query_id, name): excerpts by rank, an empty line between."""
    kept = rows.select("query_id", F.struct("rank", excerpt.alias("x")).alias("e")).groupBy("query_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return kept.select("query_id", F.array_join(F.col("e.x"), "\n\n").alias(name))


def build_prompts(messages: DataFrame, hits: DataFrame, related: DataFrame, params: Dialogs = Dialogs()) -> DataFrame:
    """(conv_id, sources_json, messages): what is sent for every valid conversation, a system message and the history.

    ``hits`` and ``related`` have query_id (a conv_id), rank, slug, title, url, heading and text, and related ones
    shared_tags. Excerpts and their introduction appear only where there are some.
    """
    valid = messages.join(validate_conversations(messages, params).where("is_valid").select("conv_id"), "conv_id", "left_semi")
    turns = history_window(valid, params.history).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", F.col("text").alias("content")))).alias("h"))
    columns = (F.col("title"), F.col("url"), F.col("heading"), F.col("text"), params.site)
    found = _joined(hits, format_excerpts(*columns), "found")
    widened = _joined(related, format_excerpts(*columns, F.col("shared_tags")), "widened")
    sources = distinct_sources(hits, related, params.site)
    rows = turns.withColumnRenamed("conv_id", "query_id")
    for part in (found, widened, sources):
        rows = rows.join(part, "query_id", "left")

    def block(intro: str, text):
        return F.when(text.isNotNull(), F.concat(F.lit(f"\n\n{intro}\n\n"), text)).otherwise(F.lit(""))

    system = F.concat(F.lit(params.system), block(params.excerpts_intro, F.col("found")), block(params.related_intro, F.col("widened")))
    first = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    history = F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.select(F.col("query_id").alias("conv_id"), F.coalesce("sources_json", F.lit('{"sources":[]}')).alias("sources_json"), F.concat(first, history).alias("messages"))
