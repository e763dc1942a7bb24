"""Exact nearest chunks by cosine distance, for a table of queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_jobs.operators import blocks
from corpus_jobs.sources.shared import materialise, shared_dir

CHUNK = ("slug", "chunk_index")
#: Digits of a distance that count for the order.
DIGITS = 12
_FOUND = "query_id {kind}, slug string, chunk_index int, distance double"


def _unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the vectors have so many numbers, these as unit vectors); a vector that is empty, zero or holds a null becomes NaN."""
    same = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False)
    rows = np.flatnonzero(same.to_numpy(zero_copy_only=False))
    if not size:
        return rows, np.full((len(rows), 1), np.nan)
    numbers = vectors.filter(same).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows, _unit(numbers.reshape(-1, size))


def query_blocks(asked: DataFrame, size: int, broadcast_bytes: int, rows: int = 4096) -> tuple[Callable[[], Iterator[pa.Table]], bool]:
    """(gives queries in tables, whether these are files): in one table that goes to every task where they have ``broadcast_bytes`` or fewer.

    More queries are written to shared storage in files of so many rows, which each task reads one after another.
    """
    if size <= broadcast_bytes:
        table = asked.toArrow().combine_chunks()
        return lambda: iter([table]), False
    path = shared_dir(asked.sparkSession, "queries")
    asked.write.option("maxRecordsPerFile", rows).parquet(path)

    def read() -> Iterator[pa.Table]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector, FileSystem

        store, base = FileSystem.from_uri(path)
        for info in sorted(store.get_file_info(FileSelector(base)), key=lambda x: x.path):
            if info.base_name.endswith(".parquet"):
                yield pq.read_table(info.path, filesystem=store, partitioning=None).combine_chunks()

    return read, True


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A task's rows in tables of so many."""
    held, n = [], 0
    for batch in blocks.small(batches, rows):
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class Balls:
    """Unit vectors of one size in balls, of which a search leaves out those that are too far away to hold a near vector.

    By the triangle inequality no vector of a ball is nearer to a query than the ball's centre less its radius.
    """

    #: What rounding may make of a length.
    SLACK = 2e-6

    def __init__(self, rows: np.ndarray, units: np.ndarray):
        good = ~np.isnan(units).any(axis=1)
        self.rows, self.units = rows[good], units[good]
        n = len(self.rows)
        balls = max(1, int(np.sqrt(n)))
        of = np.zeros(n, np.int64)
        centres = self.units[:: max(1, n // balls)][:balls]
        for _ in range(3 if n else 0):
            of = np.argmax(self.units @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, of, self.units)
            counts = np.bincount(of, minlength=len(centres))
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        order = np.argsort(of, kind="stable")
        self.rows, self.units = self.rows[order], self.units[order]
        self.starts = np.searchsorted(of[order], np.arange(len(centres) + 1))
        self.centres = centres
        away = np.linalg.norm(self.units - centres[of[order]], axis=1) if n else np.zeros(0)
        self.radii = np.array([away[a:b].max(initial=0.0) for a, b in zip(self.starts, self.starts[1:], strict=False)])
        self.scored = self.possible = 0  # pairs of a query and a ball

    def offer(self, best: blocks.Best, queries: np.ndarray, units: np.ndarray, names: list, numbers: np.ndarray, order: np.ndarray) -> None:
        """Give the vectors to ``best`` that may be among the nearest of ``queries`` (numbers and unit vectors)."""
        if not len(self.rows) or not len(queries):
            return
        far = np.sqrt(np.maximum(0.0, np.square(units).sum(1)[:, None] - 2 * units @ self.centres.T + np.square(self.centres).sum(1)[None]))
        least = far - self.radii
        nearest = np.argmin(least, axis=1)
        self.possible += least.size

        def score(ball: int, some: np.ndarray) -> None:
            own = slice(self.starts[ball], self.starts[ball + 1])
            distance = np.round(1.0 - units[some] @ self.units[own].T, DIGITS)
            self.scored += len(some)
            q, row = np.nonzero(distance <= best.worst[queries[some]][:, None])
            best.offer(queries[some][q], self.rows[own][row], distance[q, row], names, numbers, order)

        for ball in range(len(self.centres)):  # first each query's own ball, which bounds the others
            some = np.flatnonzero(nearest == ball)
            if len(some):
                score(ball, some)
        for ball in range(len(self.centres)):
            bound = np.sqrt(2 * np.maximum(0.0, best.worst[queries])) + self.SLACK
            some = np.flatnonzero((nearest != ball) & (least[:, ball] <= bound))
            if len(some):
                score(ball, some)


def _kept(best: blocks.Best, ids: pa.Array) -> pa.RecordBatch:
    query, slugs, numbers, key = best.found()
    return pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array(slugs, pa.string()), pa.array(numbers, pa.int32()), pa.array(key, mask=np.isinf(key))], names=["query_id", "slug", "chunk_index", "distance"])


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name]
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _best_of_tasks(rows: DataFrame, asked: tuple[Callable[[], Iterator[pa.Table]], bool], offer: Callable, k: int, block: int, schema: str) -> DataFrame:
    """What ``offer(best, prepared, queries)`` keeps: once a task for queries that every task has, else once for each ``block`` of rows and file of queries.

    ``offer(table)`` prepares a block of rows and gives the function of (best, queries).
    """
    read, files = asked

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = None, None
        for table in gathered(batches, block):
            prepared = offer(table)
            for queries in read():
                if files or best is None:
                    best, ids = blocks.Best(queries.num_rows, k), _column(queries, "query_id")
                if queries.num_rows:
                    prepared(best, queries)
                if files:
                    yield _kept(best, ids)
        if best is not None and not files:
            yield _kept(best, ids)

    found = rows.mapInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), *CHUNK)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sized(queries: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, numbers of queries, unit vectors) of the queries' vectors, by their size."""
    vectors = _column(queries, "embedding")
    for size in pc.unique(pc.list_value_length(vectors)).to_pylist():
        if size is not None:
            yield (size, *_matrix(vectors, size))


def semantic_top_k(queries: DataFrame, chunks: DataFrame, k: int, broadcast_bytes: int = 32 << 20, block: int = 16_384) -> DataFrame:
    """(query_id, slug, chunk_index, distance, rank): the k chunks (slug, chunk_index, embedding) nearest to each query.

    Queries (query_id, embedding) of ``broadcast_bytes`` or fewer go to every task; more are read from files by every
    task, one after another (see query_blocks), so vectors of the corpus are never copied or shuffled. A task holds
    ``block`` chunks at a time, in balls, and leaves out balls that can't hold one of a query's k nearest (see Balls). Only
    the best leave it, as keys. Distances count to 12 digits; ties go to the smaller slug, then chunk_index. Null
    embeddings take no part; a zero vector, and one of another size than the query's, has no distance and comes last.
    k <= 0 gives no rows.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    rows = chunks.where(F.col("embedding").isNotNull()).select(*CHUNK, "embedding")
    schema = _FOUND.format(kind=asked.schema["query_id"].dataType.simpleString())
    if k <= 0:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    size = asked.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 16), F.lit(0))).first()[0]

    def prepared(table: pa.Table) -> Callable:
        slugs, numbers, vectors = (_column(table, name) for name in (*CHUNK, "embedding"))
        order, names, places = blocks.in_order(slugs, numbers), slugs.to_pylist(), numbers.to_numpy()
        of_size: dict[int, tuple[Balls, np.ndarray]] = {}

        def balls(size: int) -> tuple[Balls, np.ndarray]:
            """The vectors of a size, and the first k rows of those that have no distance to it."""
            if size not in of_size:
                own = Balls(*_matrix(vectors, size))
                odd = np.setdiff1d(np.arange(len(names)), own.rows)
                of_size[size] = own, odd[np.argsort(order[odd])][:k]
            return of_size[size]

        def offer(best: blocks.Best, asked: pa.Table) -> None:
            for size, numbers_asked, units in _sized(asked):
                own, odd = balls(size)
                good = ~np.isnan(units).any(axis=1)
                own.offer(best, numbers_asked[good], units[good], names, places, order)
                near = odd
                for some in (numbers_asked[good], numbers_asked[~good]):
                    few = some[np.isinf(best.worst[some])]
                    best.offer(np.repeat(few, len(near)), np.tile(near, len(few)), np.full(len(few) * len(near), np.inf), names, places, order)
                    near = np.argsort(order)[:k]  # a query without a direction has no distance to any

        return offer

    return _best_of_tasks(rows, query_blocks(asked, size, broadcast_bytes), prepared, k, block, schema)


def chunks_in_slugs(chunks: DataFrame, query_slugs: DataFrame) -> DataFrame:
    """Every query's candidates: chunks of the slugs that ``query_slugs`` (query_id, slug, and what else) names for it."""
    return query_slugs.join(chunks, "slug")


def tagged_top_k(queries: DataFrame, wanted: DataFrame, hits: DataFrame, chunks: DataFrame, k: int, broadcast_bytes: int = 32 << 20, block: int = 16_384) -> DataFrame:
    """(query_id, slug, chunk_index, distance, rank): each query's k nearest chunks that have a tag it wants and are of no hit.

    ``wanted`` is (query_id, tag), ``hits`` (query_id, slug), ``chunks`` (slug, chunk_index, embedding, tags). Queries that
    want a tag, with their tags and hits, go to every task or to files as in semantic_top_k, so chunks are scored where
    they are read. Candidates without a distance, as of a null vector or one of another size than the query's, come
    last; ties go to the smaller slug, then chunk_index. Only keys and distances leave a task.
    """
    schema = _FOUND.format(kind=queries.schema["query_id"].dataType.simpleString())
    tags = wanted.groupBy("query_id").agg(F.collect_set("tag").alias("tags"))
    gone = hits.groupBy("query_id").agg(F.collect_set("slug").alias("gone"))
    asked = materialise(queries.select("query_id", "embedding").join(tags, "query_id").join(gone, "query_id", "left"), "asked")
    texts = F.octet_length(F.concat(F.array_join("tags", ""), F.array_join(F.coalesce("gone", F.array().cast("array<string>")), "")))
    size = asked.agg(F.coalesce(F.sum(F.coalesce(F.size("embedding"), F.lit(0)) * 8 + texts + 64), F.lit(0))).first()[0]

    def prepared(table: pa.Table) -> Callable:
        slugs, numbers, vectors, tags = (_column(table, name) for name in (*CHUNK, "embedding", "tags"))
        order, names, places = blocks.in_order(slugs, numbers), slugs.to_pylist(), numbers.to_numpy()

        def offer(best: blocks.Best, asked: pa.Table) -> None:
            wants, gone = _column(asked, "tags"), _column(asked, "gone")
            vocabulary = pc.unique(pc.list_flatten(wants))
            rows, terms = blocks.listed(tags, vocabulary)
            of, own = blocks.listed(wants, vocabulary)
            entries = blocks.Entries(of, own, np.ones(len(of)), asked.num_rows)
            hit_by, hit_slugs = pc.list_parent_indices(gone).to_numpy(), pc.list_flatten(gone)
            at = np.flatnonzero(pc.is_in(slugs, value_set=pc.unique(hit_slugs)).to_numpy(zero_copy_only=False))
            hit_queries: dict[str, list[int]] = {}
            for slug, q in zip(hit_slugs.to_pylist(), hit_by.tolist(), strict=True):
                hit_queries.setdefault(slug, []).append(q)
            sized = list(_sized(asked))
            known = {size: _matrix(vectors, size) for size, *_ in sized if size}
            for part, want, shares in entries.blocks():
                fits = (blocks.dense(rows, terms, np.ones(len(rows)), len(names), want) @ shares > 0).T
                for r in at:
                    fits[[q - part.start for q in hit_queries[names[r]] if part.start <= q < part.stop], r] = False
                distance = np.full(fits.shape, np.inf)
                for size, numbers_asked, units in sized:
                    mine = (numbers_asked >= part.start) & (numbers_asked < part.stop)
                    if size and mine.any() and len(known[size][0]):
                        near = np.round(1.0 - units[mine] @ known[size][1].T, DIGITS)
                        distance[np.ix_(numbers_asked[mine] - part.start, known[size][0])] = np.where(np.isnan(near), np.inf, near)
                q, row = np.nonzero(fits & (distance <= best.worst[part][:, None]))
                best.offer(q + part.start, row, distance[q, row], names, places, order)

        return offer

    return _best_of_tasks(chunks.select(*CHUNK, "embedding", "tags"), query_blocks(asked, size, broadcast_bytes, 1024), prepared, k, min(block, 1024), schema)
