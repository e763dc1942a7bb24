"""Tables: Parquet snapshots and JDBC."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_jobs.sources.codecs import decode_tags, decode_vector, encode_tags, encode_vector
from corpus_jobs.sources.shared import shared_dir

#: Rows of a snapshot, and the sizes of its vectors (null vectors left out).
STATS = "n_rows bigint, least_dim int, greatest_dim int"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A snapshot; where there is none yet and a schema is given, an empty table."""
    if schema is None:
        return spark.read.parquet(path)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str) -> None:
    """A new snapshot. Give it a new path: the one that the job reads from must stay as it is until the end."""
    df.write.mode("errorifexists").parquet(path)


def save_bucketed(df: DataFrame, name: str, keys: tuple[str, ...] = ("slug", "chunk_index"), buckets: int | None = None) -> DataFrame:
    """A new snapshot as a table of the catalog, bucketed and sorted by ``keys``, its files in shared storage.

    A sync joins it by these keys without a shuffle of its rows: only what is new is dealt to the buckets. Rows of one
    slug are spread over the buckets. There should be as many buckets as shuffle partitions (the default) or more.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys)  # one file a bucket
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", shared_dir(spark, name)).saveAsTable(name)
    return spark.table(name)


def write_chunks(df: DataFrame, path: str) -> DataFrame:
    """A new snapshot of chunks, and beside it one row of what was observed while it was written: n_rows, least_dim, greatest_dim."""
    seen = Observation("chunks")
    size = F.size("embedding")
    write_table(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.min(size).alias("least_dim"), F.max(size).alias("greatest_dim")), path)
    got = seen.get
    stats = df.sparkSession.createDataFrame([(got["n_rows"], got["least_dim"], got["greatest_dim"])], STATS)
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}.stats")
    return stats


def chunk_stats(spark: SparkSession, path: str) -> DataFrame:
    """What write_chunks has observed of a snapshot; no row where it wasn't written by that."""
    return read_table(spark, f"{path.rstrip('/')}.stats", STATS)


def jdbc_row(df: DataFrame) -> DataFrame:
    """``df`` with tags and vectors as JSON text and the published flag as a number."""
    out = df
    for name, kind in df.dtypes:
        if name == "tags":
            out = out.withColumn(name, encode_tags(out[name]))
        elif name == "embedding":
            out = out.withColumn(name, encode_vector(out[name]))
        elif name == "published" and kind == "boolean":
            out = out.withColumn(name, out[name].cast("int"))
    return out


def from_jdbc_row(df: DataFrame) -> DataFrame:
    """What jdbc_row does, undone."""
    out = df
    for name, kind in df.dtypes:
        if name == "tags" and kind == "string":
            out = out.withColumn(name, decode_tags(out[name]))
        elif name == "embedding" and kind == "string":
            out = out.withColumn(name, decode_vector(out[name]))
        elif name == "published" and kind != "boolean":
            out = out.withColumn(name, out[name] == 1)
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, **split) -> DataFrame:
    """A database table; ``split`` (column, lowerBound, upperBound, numPartitions) makes several tasks read it."""
    return from_jdbc_row(spark.read.jdbc(url, table, properties=properties or {}, **split))


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", properties: dict[str, str] | None = None) -> None:
    jdbc_row(df).write.jdbc(url, table, mode=mode, properties=properties or {})
