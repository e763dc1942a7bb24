"""What the operators of this subpackage share: shared storage, row locators and a few column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_jobs.sources.shared import materialise, shared_dir, small_batches

__all__ = ["materialise", "shared_dir", "small_batches"]

#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices bounded by rows and bytes, so that long documents don't fill a Python worker."""
    for batch in batches:
        n = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        yield from (batch.slice(at, n) for at in range(0, batch.num_rows, n))


def stretches(texts: list[str | None], chars: int = 1_000_000) -> Iterator[slice]:
    """Cut a batch into slices of about so many characters, so that arrays over them stay small."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def rereadable(df: DataFrame) -> DataFrame:
    """``df``, or a written copy of it where its rows don't come straight from Parquet files."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
        return df
    except AnalysisException:
        return materialise(df, "rows")


def with_locator(df: DataFrame, name: str = "_locator") -> DataFrame:
    """Add a column that names each row's place in its Parquet file and is the same at every read (see rereadable)."""
    rows = rereadable(df)
    hidden = rows.metadataColumn("_metadata")  # also where a column has that name
    return rows.select("*", F.struct(hidden["file_path"].alias("file"), hidden["row_index"].alias("row")).alias(name))


def sieve(rows: DataFrame, column: str, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``column`` may be one of the ``n`` ``keys`` (same column), and those for which it can't.

    A bitmap of the keys' hashes goes to every task: 64 bits a key, 32 MB at most. Beyond that more of the other rows
    pass, so whoever joins the first part with the keys is right in any case, and spares the second part a shuffle.
    """
    bits = min(1 << 28, 1 << max(15, (64 * n).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    bucket, bitmap = unused(rows, "_bucket"), unused(rows, "_bitmap")
    marks = F.broadcast(keys.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bitmap)))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    marked = rows.withColumn(bucket, F.bitmap_bucket_number(at)).join(marks, bucket, "left")
    return tuple(marked.where(part).drop(bucket, bitmap) for part in (maybe, ~maybe))


def drop_located(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (rereadable) but those whose place is in ``gone`` (_locator, written), with all their columns."""
    name = unused(docs, "_locator")
    gone = gone.select(F.col("_locator").alias(name))
    maybe, stay = sieve(with_locator(docs, name), name, gone, gone.count())
    return stay.unionByName(maybe.join(gone, name, "left_anti")).drop(name)


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, how: str = "inner", most_hot: int = 20_000) -> DataFrame:
    """``rows`` joined (inner or left) with ``keyed``, which has a row for every key and in ``count`` how many of ``rows`` have it.

    Keys of more rows than a share of 1 in ``most_hot`` (so there are fewer of them) aren't shuffled: their side of the
    join goes to every task. Both sides are read twice where there are such keys.
    """
    total, most = keyed.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    least = max(256, total // most_hot)
    if most <= least:
        return rows.join(keyed, key, how)
    hot = F.col(count) > least
    some = F.broadcast(keyed.where(hot))
    return rows.join(some, key).unionByName(rows.join(some.select(key), key, "left_anti").join(keyed.where(~hot), key, how))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(numbers: Column, block: int = 256) -> Column:
    """Array of the sums before each element, and the total at the end; two levels, so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: a + x)

    def summed(xs: Column) -> Column:
        n = F.size(xs)
        sums = F.transform(F.sequence(F.lit(0), F.floor(n / block).cast("int")), lambda b: total(F.slice(xs, b * block + 1, block)))
        starts = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))

        def at(i: Column, before: Column) -> Column:
            b = F.floor(i / block).cast("int")
            return F.get(before, b) + total(F.slice(xs, b * block + 1, i % block))

        return let(starts, lambda before: F.transform(F.sequence(F.lit(0), n), lambda i: at(i, before)))

    return let(F.transform(numbers, lambda x: x.cast("long")), summed)


def learns(id_col: str) -> Column:
    """True for rows to learn from: crc32 of the id as text, modulo 5, is not 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0
