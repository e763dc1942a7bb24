"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_jobs.llm.common import join_counted, materialise


def _least(edges: DataFrame) -> DataFrame:
    """(a, m, n): the least neighbour of every node, and the number of its edges."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return join_counted(both.where("b > a"), _least(both), "a", "n").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these. Edges run from larger to smaller nodes."""
    least = _least(edges)
    inner = join_counted(edges, least, "a", "n").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint) but the roots; a root is the least node it reaches.

    Large and small stars take turns until nothing changes, a number of rounds that grows with the logarithm of the
    nodes; each star is written to shared storage. The centre of a large star isn't shuffled (see join_counted).
    """
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, after = None, mark(now)
    while after[0] and after != before:
        now = materialise(_small_star(materialise(_large_star(now), "edges")), "edges")
        before, after = after, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
