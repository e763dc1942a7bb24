"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by linear grouping.

The plan is made on the driver from the histogram of piece lengths alone, of at most ``capacity`` rows. Large lengths
are rounded up within groups of equal cardinality, configurations of the few rounded sizes are optimised by column
generation, actual lengths are put in their places, and what is left is best-fitted, largest first. Each piece then
finds its place by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_jobs.llm.common import materialise, partitions, small, unused


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids, if asked for).

    A document's ids are those of its whole text (null: empty) and ``end_id``; only documents longer than
    ``capacity`` are cut, each piece but the last being full. Repeated rows give repeated pieces. Texts of any length are
    tokenised whole; an empty table gives no pieces. Other columns aren't read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [rows.schema["doc_id"], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpus_jobs.llm.tokens import word_ids

        words, end = word_ids(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in small(batches):
            of, numbers, starts, lengths, sums, ids = [], [], [], [], [], []
            for row, raw in enumerate(words(batch.column(1).to_pylist())):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    of.append(row)
                    numbers.append(k)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("int64"))
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return rows.mapInArrow(pieces, T.StructType(fields))


def _groups(counts: dict[int, int], most: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: (rounded size, runs of [length, count], largest first), ``most`` groups of equal cardinality."""
    lengths = sorted(counts, reverse=True)
    if len(lengths) <= most:
        return [(length, [[length, counts[length]]]) for length in lengths]
    share, groups = -(-sum(counts.values()) // most), []
    room = 0
    for length in lengths:
        left = counts[length]
        while left:
            if not room:
                groups.append((length, []))
                room = share
            took = min(left, room)
            groups[-1][1].append([length, took])
            left, room = left - took, room - took
    return groups


def _best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that has the greatest value."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), dtype=np.int16)
    for g, size in enumerate(sizes):
        before = best.copy()
        for t in range(1, capacity // size + 1):
            other = before[: capacity + 1 - t * size] + t * values[g]
            better = other > best[t * size :] + 1e-12
            best[t * size :][better] = other[better]
            taken[g, t * size :][better] = t
    picked, room = np.zeros(len(sizes)), capacity
    for g in range(len(sizes) - 1, -1, -1):
        picked[g] = taken[g, room]
        room -= int(picked[g]) * sizes[g]
    return float(best[capacity]), picked


def _configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, from the linear relaxation rounded down."""
    if not sizes:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, dtype=float)
    for _ in range(rounds):
        worth, column = _best_configuration(sizes, np.linalg.solve(basis.T, np.ones(len(sizes))), capacity)
        if worth <= 1 + 1e-9:
            break
        used, change = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.full(len(sizes), np.inf)
        ratio[change > 1e-9] = used[change > 1e-9] / change[change > 1e-9]
        basis[:, int(np.argmin(ratio))] = column
    used = np.floor(np.linalg.solve(basis, need) + 1e-9).astype(int)
    return [(basis[:, k].astype(int), int(used[k])) for k in range(len(sizes)) if used[k] > 0]


def plan(histogram: dict[int, int], capacity: int, small: float = 0.34, groups: int = 256) -> tuple[list[tuple[int, ...]], int]:
    """Places for pieces: rows (length, first rank, last rank + 1, pieces a sequence, first sequence, offset), and the number of sequences."""
    least = int(capacity * small)
    runs: list[tuple[list[tuple[int, int]], int]] = []  # contents of a sequence as (length, times), and how many such
    open_runs: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(items: list[tuple[int, int]], count: int) -> None:
        room = capacity - sum(length * q for length, q in items)
        if not room:
            runs.append((items, count))
            return
        if room not in open_runs:
            insort(rooms, room)
        open_runs.setdefault(room, []).append((items, count))

    rest = {length: n for length, n in histogram.items() if length <= least}
    if capacity in histogram:
        runs.append(([(capacity, 1)], histogram[capacity]))
    grouped = _groups({length: n for length, n in histogram.items() if least < length < capacity}, groups)
    for pattern, times in _configurations([size for size, _ in grouped], [sum(n for _, n in actual) for _, actual in grouped], capacity):
        columns = []  # for each place of the pattern, its actual lengths as runs
        for g, copies in enumerate(pattern):
            for _ in range(copies):
                left, column = times, []
                while left and grouped[g][1]:
                    head = grouped[g][1][0]
                    took = min(left, head[1])
                    column.append([head[0], took])
                    head[1] -= took
                    left -= took
                    if not head[1]:
                        grouped[g][1].pop(0)
                columns.append(column)
        left = times
        while left:
            heads = [c[0] for c in columns if c]
            step = min([left, *(h[1] for h in heads)])
            put([(h[0], 1) for h in heads], step)
            left -= step
            for c in columns:
                if c:
                    c[0][1] -= step
                    if not c[0][1]:
                        c.pop(0)
    for _, actual in grouped:
        for length, n in actual:
            rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                q = min(capacity // length, left)
                put([(length, q)], left // q)
                left -= left // q * q
                continue
            room = rooms[k]
            items, count = open_runs[room].pop()
            if not open_runs[room]:
                del open_runs[room], rooms[k]
            q = min(room // length, left)
            step = min(count, left // q)
            if step < count:
                put(items, count - step)
            put([*items, (length, q)], step)
            left -= step * q
    places, ranks, sequence = [], {}, 0
    for items, count in [*runs, *(x for xs in open_runs.values() for x in xs)]:
        offset = 0
        for length, q in items:
            rank = ranks.get(length, 0)
            places.append((length, rank, rank + count * q, q, sequence, offset))
            ranks[length] = rank + count * q
            offset += length * q
        sequence += count
    return places, sequence


def pack(pieces: DataFrame, capacity: int = 2048, small_share: float = 0.34, groups: int = 256) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others) with sequence_id and offset, gapless from 0 in each sequence.

    Columns of these two names are replaced, all others stay. Repeated rows get places of their own; no rows give none.
    ``pieces`` is read several times, so give it written. Broadcast are the plan and the counts of the rank buckets,
    whose sizes follow from the capacity and the number of shuffle partitions, not from the data.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    salts, salt, rank, base, n, size, first, end, q, sequence, place = (unused(pieces, x) for x in ("_salts", "_salt", "_rank", "_base", "_n", "_length", "_first", "_end", "_q", "_sequence", "_offset"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    places, _ = plan(histogram, capacity, small_share, groups)
    bucket = max(256, sum(histogram.values()) // (4 * partitions(spark)))
    counts = spark.createDataFrame([(length, -(-k // bucket)) for length, k in histogram.items()], f"length long, {salts} long")
    salted = pieces.join(F.broadcast(counts), "length").withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), salts)).drop(salts)
    before = F.sum(n).over(Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1))
    bases = salted.groupBy("length", salt).agg(F.count("*").alias(n)).select("length", salt, F.coalesce(before, F.lit(0)).alias(base))
    others = [c for c, kind in pieces.dtypes if c not in ("doc_id", "piece", "length") and not kind.startswith(("array", "map", "struct"))]
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "piece", *(F.col(f"`{c}`") for c in others))))
    ranked = ranked.join(F.broadcast(bases), ["length", salt]).withColumn(rank, F.col(rank) + F.col(base) - 1)
    table = spark.createDataFrame(places, f"{size} long, {first} long, {end} long, {q} long, {sequence} long, {place} long")
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col(size)) & (F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(end)))
    at = F.col(rank) - F.col(first)
    return placed.select(*(F.col(f"`{c}`") for c in pieces.columns), (F.col(sequence) + F.floor(at / F.col(q))).cast("long").alias("sequence_id"), (F.col(place) + at % F.col(q) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut and pack: one row per piece, with doc_id, piece, start, length, ids_crc32, sequence_id and offset (and ids).

    Nulls, repeated rows, very long texts and empty tables are as in cut and pack. Executors with little memory want
    common.small_batches set by the application, which bounds the Arrow batches of texts that come to a Python worker.
    """
    return pack(materialise(cut(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity)
