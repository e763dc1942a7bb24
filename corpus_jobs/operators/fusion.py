"""Weighted reciprocal-rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = ("slug", "chunk_index")


def reciprocal_rank_fusion(semantic: DataFrame, lexical: DataFrame, k: int, rrf_k: int = 60, semantic_weight: float = 1.0, lexical_weight: float = 0.7) -> DataFrame:
    """(query_id, slug, chunk_index, distance, score, rank): the k best of both rankings (query_id, slug, chunk_index, rank).

    A chunk's score is the sum of weight / (rrf_k + rank) over the rankings that have it, at its first rank in each; a
    weight of 0 still lets its ranking's chunks in. Chunks of the lexical ranking alone have distance 0. Ties (scores
    rounded to 12 digits) go to the smaller slug, then chunk_index.
    """
    def voted(hits: DataFrame, weight: float, distance) -> DataFrame:
        once = hits.groupBy("query_id", *CHUNK).agg(F.min("rank").alias("r"), F.min_by(distance, "rank").alias("d"))
        return once.select("query_id", *CHUNK, (F.lit(float(weight)) / (F.lit(rrf_k) + F.col("r"))).alias("part"), "d")

    votes = voted(semantic, semantic_weight, F.col("distance")).unionByName(voted(lexical, lexical_weight, F.lit(None).cast("double")))
    fused = votes.groupBy("query_id", *CHUNK).agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("distance"), F.round(F.sum("part"), 12).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *CHUNK)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
