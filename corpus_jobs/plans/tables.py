"""Notes, chunks and queries made from the driver's tables, all rows of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_jobs.functions.chunking import pieces_of, split_long_text
from corpus_jobs.functions.text import let, normalize_text
from corpus_jobs.operators import blocks
from corpus_jobs.sources.shared import materialise, shared_dir

#: The day on which the notes are looked at: those of the last days are still to come.
AS_OF = "2024-02-20"
MODEL = "test-embedder"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its files are too few and too small for that; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per document; its labels give the published flag and a tag."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    slug, title = F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        slug.alias("slug"),
        F.concat(F.lit("/notes/"), slug, F.lit(".html")).alias("url"),
        title.alias("title"),
        title.alias("heading"),
        title.alias("list_title"),
        F.lit(None).cast("string").alias("description"),
        "lang",
        F.col("source").alias("category"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.lit("").alias("date_text"),
        F.col("text").alias("content_html"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("published"),
        F.array_compact(F.array("lang", "source", F.when(F.col("toxic") == 1, "toxic"))).alias("tags"),
    )


def _pieces() -> Column:
    """Pieces of a document's normalised text."""
    none = F.array().cast("array<string>")
    return let(normalize_text(F.col("text")), lambda t: F.when(t == "", none).otherwise(split_long_text(t)))


def _exploded(docs: DataFrame, pieces: Column) -> DataFrame:
    rows = docs.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("slug"), F.posexplode(pieces).alias("chunk_index", "text"))
    return rows.select("slug", "chunk_index", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("heading"), "text", "doc_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document's normalised text: slug, chunk_index, heading, text, doc_id."""
    return _exploded(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), _pieces())


def _cut(docs: DataFrame) -> DataFrame:
    """The rows of _exploded with _pieces, cut in Arrow batches, which takes a fraction of the time that column expressions take."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.small(batches):
            rows, numbers, pieces = pieces_of(batch.column(3).to_pylist())
            slug, heading, doc_id = (batch.column(i).take(pa.array(rows, pa.int64())) for i in (1, 2, 0))
            made = pa.RecordBatch.from_arrays([slug, pa.array(numbers, pa.int32()), heading, pa.array(pieces, pa.string()), doc_id], names=["slug", "chunk_index", "heading", "text", "doc_id"])
            yield from blocks.small([made])

    number = F.col("doc_id").cast("string")
    rows = docs.select("doc_id", F.concat_ws("/", "source", number).alias("slug"), F.concat(F.lit("Doc "), number).alias("heading"), "text")
    return rows.mapInArrow(cut, f"slug string, chunk_index int, heading string, text string, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def embedded_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, embeddings), both written: the chunks, and by their keys the embedding of their document's number at the first chunk and none elsewhere.

    Vectors stand apart from texts, so that only keys meet them.
    """
    made = materialise(_cut(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))), "chunks")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding")
    placed = made.select("doc_id", "slug", "chunk_index").join(vectors, ["doc_id", "chunk_index"], "left")
    return made.drop("doc_id"), materialise(placed.drop("doc_id"), "embeddings")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query per benchmark text, with the embedding of its number: query_id, text, embedding."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left").select(F.col("item_id").alias("query_id"), "text", "embedding")


def known_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that an older table knew, those with labels, and whether they were edited since: doc_id, edited."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("edited"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id")


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older chunk table: the known documents; those edited since had another text and a chunk more."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).join(known_before(spark, sf_dir), "doc_id")

    def then(pieces: Column) -> Column:
        old = F.concat(F.transform(pieces, lambda x: F.concat(F.lit("old "), x)), F.array(F.lit("gone")))
        return F.when(F.col("edited") & (F.size(pieces) > 0), old).otherwise(pieces)

    rows = _exploded(docs, let(_pieces(), then))
    return rows.select("slug", "chunk_index", "heading", "text", F.sha2(F.concat(F.lit(MODEL), F.lit("\0"), F.col("text")), 256).alias("content_hash"), "doc_id")


def note_files(spark: SparkSession, files: DataFrame) -> str:
    """Write every row of ``files`` (path, raw) as a file below a new folder of the shared storage, in tasks; gives the folder."""
    root = shared_dir(spark, "notes")

    def written(batches):
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(root)
        for batch in batches:
            for path, raw in zip(batch["path"].to_pylist(), batch["raw"].to_pylist(), strict=True):
                store.create_dir(f"{base}/{path}".rpartition("/")[0])
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(raw.encode())
            yield batch.select(["path"]).slice(0, 0)

    files.select("path", "raw").mapInArrow(written, "path string").count()
    return root


def note_html(c: Column) -> Column:
    """A body of two sections: the text's lines under one heading, and a short one, whose heading has a smaller rank."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return F.concat(F.lit("<h2>Main &amp; first</h2><script>var x = '</p><h2>no</h2>';</script><p>"), c, F.lit("</p><h3>More</h3><ul><li>short</li><li>tail</li></ul>"))
