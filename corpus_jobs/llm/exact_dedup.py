"""Exact deduplication by a stateful stream: a disk-backed keyed state remembers every text that has been seen.

The state has no expiry. Under a text's digest it keeps how many rows came, the row that stays so far and the locator
of that row's content. Digests that come again are hits, for which whole texts are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_jobs.llm.common import SPACES, drop_located, join_counted, materialise, rereadable, shared_dir, sieve, with_locator

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a store is closed after its task, so that an executor has only those open (some MB each) whose tasks run
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: A bucket of equal texts is checked in parts of about so many rows.
_PART = 5_000


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def _on_disk(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, with memory bounded for each executor."""
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    try:
        for k, v in _STATE_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """What the state is told of each row: doc_id, digest, chars and the row's locator."""
    return docs.select(F.col(id_col).alias("doc_id"), digest(normalised(F.col(text_col))).alias("digest"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"), "_locator")


def seen(stream: DataFrame) -> DataFrame:
    """State by digest over streamed (or plain) arrivals: rows so far, and the one that stays.

    The longest original text stays, then the smallest id (null last), then the first place in the files.
    """
    first = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_locator")
    return stream.groupBy("digest").agg(F.count("*").alias("n"), F.min(first).alias("first"))


def run_state(spark: SparkSession, log: str, schema, bytes_per_trigger: int | None = None) -> DataFrame:
    """Stream the Parquet log of arrivals through the state, and return its last version: digest, n, first.

    Every micro-batch writes the entries it changed under its own number, so a batch that runs twice after a failure
    overwrites itself; state and progress live in the shared checkpoint. A micro-batch takes some 64 MB of the log for
    each core, so a larger cluster takes fewer of them.
    """
    out = shared_dir(spark, "dedup-state")

    def keep(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    size = bytes_per_trigger or (64 << 20) * spark.sparkContext.defaultParallelism
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", size).parquet(log)
    with _on_disk(spark):
        query = seen(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", shared_dir(spark, "dedup-checkpoint")).foreachBatch(keep).start()
        query.awaitTermination()
    if query.lastProgress is None:  # no batch: the log has no file
        return seen(spark.read.schema(schema).parquet(log))
    versions = spark.read.parquet(out)
    last = versions.groupBy("digest").agg(F.max_by(F.struct("n", "first"), "batch").alias("s"))
    return last.select("digest", "s.n", "s.first")


def _texts(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The hits with their texts: only these rows' texts are shuffled, all others stay where they are read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw"), "_locator")
    found = sieve(rows, "_locator", hits, hits.count())[0].join(hits, "_locator")
    return found.select("doc_id", normalised(F.col("raw")).alias("body"), F.length(F.coalesce("raw", F.lit(""))).alias("chars"), "digest", "n", "_kept", "_locator")


def _collided(found: DataFrame) -> DataFrame:
    """Digests of which a text differs from the one that the state points at; copies are compared in parts of a bounded size."""
    parts = F.ceil(F.col("n") / _PART).cast("int")
    pointed = found.where(F.col("_locator") == F.col("_kept")).select("digest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("body").alias("kept_body"))
    members = found.select("digest", F.pmod(F.xxhash64("_locator"), parts).cast("int").alias("part"), "body")
    return members.join(pointed, ["digest", "part"]).where(F.col("body") != F.col("kept_body")).select("digest").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, bytes_per_trigger: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest, _locator.

    Texts are equal when they are without white space; null counts as empty. Exactly one row of each group is kept,
    also where rows repeat with their id: the longest text, then the smallest id (null last), then the first place in
    the files. Rows whose digest collides with another text's are grouped by whole text. Other columns are not read,
    so their names don't matter; an empty table gives no rows. Rows with a digest of their own are never shuffled.
    """
    spark = docs.sparkSession
    docs = with_locator(docs.select(F.col(id_col), F.col(text_col)))
    told, path = arrivals(docs, id_col, text_col, digest), shared_dir(spark, "arrivals")
    told.write.parquet(path)
    log = spark.read.schema(told.schema).parquet(path)
    states = materialise(run_state(spark, path, told.schema, bytes_per_trigger).where("n > 1"), "states")
    maybe, alone = sieve(log, "digest", states, states.count())
    several = materialise(join_counted(maybe, states, "digest", "n", "left"), "several")
    hits = several.where("n IS NOT NULL")
    own = several.where("n IS NULL").select(*alone.columns).unionByName(alone)

    def out(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_locator") == F.col("first._locator")).alias("kept"), "digest", "_locator")

    single = own.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "_locator")
    found = materialise(_texts(docs, hits.select("digest", "n", F.col("first._locator").alias("_kept"), "_locator"), id_col, text_col), "hit-texts")
    collided = materialise(_collided(found), "collided")
    if collided.isEmpty():
        return single.unionByName(out(hits))
    split = found.join(F.broadcast(collided) if collided.count() <= 100_000 else collided, "digest", "left_semi").drop("n", "_kept")
    first = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_locator")
    classes = split.groupBy("digest", "body").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    return single.unionByName(out(hits.join(collided, "digest", "left_anti"))).unionByName(out(split.join(classes, ["digest", "body"])))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Of equal texts (without white space; null as empty) the longest stays, of these the smallest id (null last), of
    repeated rows the first in the files. Whole texts of any length are compared; an empty table stays empty.
    """
    docs = rereadable(docs)
    gone = exact_groups(docs, id_col, text_col).where(~F.col("kept")).select("_locator")
    return drop_located(docs, materialise(gone, "gone"))
