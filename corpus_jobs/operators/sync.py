"""Keeping the note and chunk tables in step with their source, by joins that give new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("slug", "chunk_index")


def changed_chunks(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``new`` (with content_hash) with is_changed: the stored hash is missing or another. Of ``stored``, only keys and hash are read."""
    known = stored.select(*KEYS, F.col("content_hash").alias("_stored"))
    return new.join(known, list(KEYS), "left").withColumn("is_changed", ~F.col("content_hash").eqNullSafe(F.col("_stored"))).drop("_stored")


def sync_counts(changes: DataFrame) -> DataFrame:
    """One row: how many chunks are to embed, and how many are unchanged."""
    return changes.agg(F.count_if("is_changed").alias("embedded"), F.count_if(~F.col("is_changed")).alias("unchanged"))


def _upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], kept: dict[str, Column], now: Column) -> DataFrame:
    """Rows of both sides by key; the incoming side wins except for the columns ``kept``."""
    new, old = incoming.select(F.struct(*incoming.columns).alias("n"), *keys), stored.select(F.struct(*stored.columns).alias("o"), *keys)
    both = old.join(new, keys, "full_outer")
    came = F.col("n").isNotNull()

    def of(name: str) -> Column:
        if name == "updated_at":
            return F.when(came, now).otherwise(F.col("o.updated_at"))
        if name in kept:
            return kept[name]
        return F.when(came, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")) if name in incoming.columns else F.col(f"o.{name}")

    return both.select(*((F.col(name) if name in keys else of(name).alias(name)) for name in stored.columns))


def upsert_notes(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """All notes of both sides; incoming ones replace every field but created_at, and are updated ``now`` even if equal."""
    return _upsert(stored, incoming, ["slug"], {"created_at": F.coalesce("o.created_at", now)}, now)


def upsert_chunks(stored: DataFrame, embedded: DataFrame, now: Column) -> DataFrame:
    """All chunks of both sides; embedded ones replace the stored ones, which otherwise stay as they are."""
    return _upsert(stored, embedded, list(KEYS), {}, now)


def _stale(stored: DataFrame, keep: DataFrame, allow_empty: bool) -> DataFrame:
    if not allow_empty and keep.isEmpty():
        raise ValueError("nothing to keep: this would clear the table")
    return stored.join(keep.select("slug"), "slug", "left_semi").select(*stored.columns)


def delete_stale_notes(stored: DataFrame, keep: DataFrame, allow_empty: bool = True) -> DataFrame:
    """Notes whose slug is in ``keep``; an empty ``keep`` clears the table, unless told to refuse."""
    return _stale(stored, keep, allow_empty)


def delete_stale_chunk_slugs(stored: DataFrame, keep: DataFrame, allow_empty: bool = True) -> DataFrame:
    """The same for chunks, all of a slug at once."""
    return _stale(stored, keep, allow_empty)


def delete_chunk_tail(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """Chunks but those at or after their slug's new count (slug, n); slugs without a count stay whole."""
    known = counts.select("slug", F.col("n").alias("_n"))
    rows = stored.join(known, "slug", "left").where(F.col("_n").isNull() | (F.col("chunk_index") < F.col("_n")))
    return rows.select(*stored.columns)
