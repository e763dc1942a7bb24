"""Notes that share tags with a query's hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wanted_tags(hit: DataFrame, note_tags: DataFrame) -> DataFrame:
    """(query_id, tag): the tags of each query's hits (query_id, slug)."""
    return hit.join(note_tags, "slug").select("query_id", F.explode("tags").alias("tag")).distinct()


def tag_neighbors(hits: DataFrame, note_tags: DataFrame) -> DataFrame:
    """(query_id, slug, shared_tags): notes of ``note_tags`` (slug, tags) that share a tag with a query's hits and are no hit.

    Shared tags stand in the neighbour's own order. Queries meet a tag once, however many of their hits have it, and
    tags meet the different lists of tags that notes have; only then does a list become its notes.
    """
    hit = hits.select("query_id", "slug").distinct()
    wanted = wanted_tags(hit, note_tags)
    edges = note_tags.select("tags").distinct().select("tags", F.posexplode("tags").alias("pos", "tag"))
    shared = wanted.join(edges, "tag").groupBy("query_id", "tags").agg(F.sort_array(F.collect_list(F.struct("pos", "tag"))).alias("s"))
    rows = shared.select("query_id", "tags", F.array_distinct(F.col("s.tag")).alias("shared_tags")).join(note_tags, "tags")
    return rows.join(hit, ["query_id", "slug"], "left_anti").select("query_id", "slug", "shared_tags")
