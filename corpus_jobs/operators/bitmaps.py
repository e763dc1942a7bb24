"""Semi-joins where rows are read: bitmaps of keys go to the tasks, so that the rows aren't shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_jobs.sources.shared import materialise

#: Bits of a bitmap at most: 32 MB.
MOST_BITS = 1 << 28


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _marked(rows: DataFrame, column: str, keys: DataFrame, n: int, seed: int) -> tuple[DataFrame, Column, list[str]]:
    """``rows`` with two columns more, whether a row may have one of the ``n`` ``keys``, and these columns' names."""
    bits = min(MOST_BITS, 1 << max(15, (64 * n).bit_length()))
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(bits))
    bucket, bitmap = _free(rows, "_bucket"), _free(rows, "_bitmap")
    marks = F.broadcast(keys.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bitmap)))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn(bucket, F.bitmap_bucket_number(at)).join(marks, bucket, "left"), maybe, [bucket, bitmap]


def split_rows(rows: DataFrame, column: str, keys: DataFrame, broadcast_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``column`` is one of the ``keys`` (column of that name), and the others, exactly, without a shuffle of the rows.

    Keys of ``broadcast_bytes`` or fewer go to every task. Beyond that a cascade of bitmaps does: one of the keys, one of
    the other keys of ``rows`` that pass it, one of the keys that pass both, and so on until none is left in the wrong
    place, each some 64 times smaller than the one before while a bitmap holds 64 bits a key. Only keys are shuffled for
    it. A null isn't a key.
    """
    inside = keys.select(column).where(F.col(column).isNotNull()).distinct()
    size = inside.agg(F.coalesce(F.sum(F.octet_length(F.col(column).cast("string")) + 16), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return tuple(rows.join(F.broadcast(inside), column, how).select(*rows.columns) for how in ("left_semi", "left_anti"))
    inside = materialise(inside, "keys")
    outside = materialise(rows.select(column).where(F.col(column).isNotNull()).distinct().join(inside, column, "left_anti"), "other-keys")
    levels: list[tuple[DataFrame, int]] = []
    mine, others = inside, outside
    while n := mine.count():
        levels.append((mine, n))
        marked, maybe, extra = _marked(others, column, mine, n, len(levels))
        mine, others = materialise(marked.where(maybe).drop(*extra), "passing-keys"), mine
    out, names = rows, []
    passed, chosen = F.col(column).isNotNull(), F.lit(False)
    for level, (own, n) in enumerate(levels, 1):
        out, maybe, extra = _marked(out, column, own, n, level)
        names.append(_free(out, f"_level{level}"))
        out = out.withColumn(names[-1], maybe).drop(*extra)
        # a key that passes every level but an even one isn't among the others of that level
        chosen = chosen | (passed & ~F.col(names[-1])) if level % 2 == 0 else chosen
        passed = passed & F.col(names[-1])
    if len(levels) % 2:
        chosen = chosen | passed
    return tuple(out.where(part).select(*rows.columns) for part in (chosen, ~chosen))


def rows_of(rows: DataFrame, column: str, keys: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The first part of split_rows."""
    return split_rows(rows, column, keys, broadcast_bytes)[0]
