"""Approximate nearest neighbours by collision counting over query-centred windows.

A block of vectors keeps one sorted array per random projection. Around each query's own projections windows widen
step by step (virtual rehashing); a vector collides once per window that it lies in, and those that collide often
enough are verified by their exact distance. A query is done in a block when its k nearest verified ones lie within the
radius that its windows stand for. Blocks meet all queries, and their best are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_jobs.llm.common import unused, with_locator


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, v, and the columns ``extra``) of the rows that can take part: with an id, not null or zero, all components finite."""
    v = F.col(vector_col)

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))

    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull())
    return rows.where(~F.exists(v, bad)).where(F.exists(v, lambda x: x != 0)).select(F.col(id_col).alias("id"), v.alias("v"), *extra)


def _collisions(place: np.ndarray, left: np.ndarray, right: np.ndarray, tile: int = 2048) -> np.ndarray:
    """For each query, in how many projections each vector's place in the sorted array is in the query's window."""
    low, size = left.astype(place.dtype)[:, :, None], (right - left).astype(place.dtype)[:, :, None]
    counts = np.zeros((left.shape[1], place.shape[1]), np.uint16)
    for at in range(0, place.shape[1], tile):
        part = place[:, None, at : at + tile]
        shape = (left.shape[1], part.shape[2])
        above, inside = np.empty(shape, place.dtype), np.empty(shape, bool)
        for first in range(0, len(place), 255):  # what a byte can count
            total = np.zeros(shape, np.uint8)
            for i in range(first, min(first + 255, len(place))):
                np.subtract(part[i], low[i], out=above)  # of unsigned numbers: what is below wraps round
                np.less(above, size[i], out=inside)
                np.add(total, inside.view(np.uint8), out=total)
            counts[:, at : at + tile] += total
    return counts


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, projections: int, threshold: float, width: float, growth: float = 1.1, strip: int = 64, pilot: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, distance) of the k nearest found in one block for each query vector, and how many were verified.

    ``query`` and ``row`` are places in ``q`` and ``x``; rows with the query's own id are left out. At radius R windows
    reach ``width`` * R to either side. Vectors that collide in ``threshold`` of the projections are verified; the
    radius grows by ``growth``, but not beyond the k-th best distance so far, which bounds the true one. It starts below
    the k-th best distance in the block's first ``pilot`` rows.
    """
    axes = np.random.default_rng(11).standard_normal((projections, x.shape[1]))
    p = axes @ x.T
    order, n = np.argsort(p, axis=1), len(ids)
    p = np.take_along_axis(p, order, axis=1)
    place = np.empty(order.shape, np.uint16 if n < 1 << 16 else np.uint32)
    np.put_along_axis(place, order, np.arange(n, dtype=place.dtype)[None], axis=1)
    least, usual, verified = int(np.ceil(threshold * projections)), max(float(p.std()) * 0.25, 1e-12), 0
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), strip):
        part = q[a : a + strip]
        pq = axes @ part.T
        seen = np.zeros((len(part), n), bool)
        rows, best = [np.zeros(0, np.int64)] * len(part), [np.zeros(0)] * len(part)
        radius, live = np.full(len(part), usual), np.arange(len(part))
        if n > pilot > k:
            near = np.stack([np.square(x[:pilot] - v).sum(axis=1) for v in part])
            radius = np.maximum(0.85 * np.sqrt(np.partition(near, k, axis=1)[:, k]), usual * 1e-3)
        while len(live):
            reach = width * radius[live]
            left = np.array([np.searchsorted(p[i], pq[i, live] - reach, "left") for i in range(projections)])
            right = np.array([np.searchsorted(p[i], pq[i, live] + reach, "right") for i in range(projections)])
            collided = (_collisions(place, left, right) >= least) & ~seen[live]
            seen[live] |= collided
            verified += int(collided.sum())
            everything = ~left.any(axis=0) & (right == n).all(axis=0)
            done = np.zeros(len(live), bool)
            for at, j in enumerate(live.tolist()):
                near = np.flatnonzero(collided[at])
                near = near[ids[near] != query_ids[a + j]]
                if len(near):
                    d, near = np.concatenate((best[j], np.sqrt(np.square(x[near] - part[j]).sum(axis=1)))), np.concatenate((rows[j], near))
                    kept = np.lexsort((ids[near], d))[:k]
                    rows[j], best[j] = near[kept], d[kept]
                bound = best[j][-1] if len(best[j]) == k else np.inf
                done[at] = bound <= radius[j] or everything[at]
                radius[j] = min(radius[j] * growth, max(bound, radius[j]))
            live = live[~done]
        found += [(a + j, rows[j], best[j]) for j in range(len(part))]
    query = np.repeat(np.array([j for j, _, _ in found], np.int64), [len(r) for _, r, _ in found])
    return query, np.concatenate([np.zeros(0, np.int64), *(r for _, r, _ in found)]), np.concatenate([np.zeros(0), *(d for _, _, d in found)]), verified


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 192, threshold: float = 0.785, width: float = 1.4, block: int = 8192, chunk: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row where ``is_query`` holds, the k nearest found among all others.

    The score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. Rows
    that can't take part (see valid_vectors) are left out, and vectors are searched among those of their own length. A
    task holds a block of about ``block`` vectors, whose sorted arrays it makes once, and up to about ``chunk`` queries,
    whatever the number of either. With windows of ``width`` radii a vector at the radius collides in a
    projection with a chance of 0.84, a nearer one more often, so few of the k nearest miss the ``threshold``. Other columns are not read; an empty table gives no rows.

    Rows that share an id are searched for together and get one ranking, by the least distance to any of them; none of
    them is in it. As neighbours of others they are rows of their own, so their id can take several ranks. Rows are dealt
    to blocks by their place in the files, so neither a common id nor a common vector meets in one block.
    """
    n, place = F.size("v").alias("n"), unused(vectors, "_locator")
    placed = with_locator(vectors, place)
    rows = valid_vectors(placed, id_col, vector_col, (place,)).select("id", "v", n, F.xxhash64(place).alias("row"))
    queries = valid_vectors(placed.where(is_query), id_col, vector_col).select("id", "v", n).distinct()

    def parts(of: DataFrame, size: int, name: str) -> DataFrame:
        return of.groupBy("n").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    # a row for each length
    grid = parts(rows, block, "blocks").join(parts(queries, chunk, "chunks"), "n").collect()
    grid = F.broadcast(vectors.sparkSession.createDataFrame(grid, "n int, blocks int, chunks int"))
    data = rows.join(grid, "n").select("id", "v", "n", "row", F.pmod("row", "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    asked = queries.join(grid, "n").select("id", "v", "n", F.pmod(F.xxhash64("id", "v"), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def search(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "row": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, q = (np.stack(part["v"].to_numpy()).astype(np.float64) for part in (left, right))
        ids, query_ids = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        query, at, distance, _ = search_block(ids, x, query_ids, q, k, projections, threshold, width)
        return pd.DataFrame({"query_id": query_ids[query], "row": left["row"].to_numpy(np.int64)[at], "vec_id": ids[at], "score": distance})

    found = data.groupBy("n", "block", "chunk").cogroup(asked.groupBy("n", "block", "chunk")).applyInPandas(search, "query_id long, row long, vec_id long, score double")
    # a row found for several vectors of one id counts once, at the least distance
    first = F.row_number().over(Window.partitionBy("query_id", "row").orderBy("score"))
    once = found.repartition("query_id").withColumn("first", first).where("first = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
