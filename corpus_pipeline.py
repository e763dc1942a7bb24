"""From raw documents to packed training sequences: quality, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept; all but the last return
the columns of ``documents``. Between the stages rows go through Parquet in shared storage.

In every stage an empty table gives no rows, whole texts of any length are read, and extra columns stay as they are,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_jobs.llm import common, exact_dedup, packing, quality, secrets, simhash

#: Documents with a lower score go.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted to the labelled ones, rejects.

    A null text counts as empty, and is judged like any other; a null id has no label to learn from. Repeated rows get
    equal scores, so they stay or go together. Without labels of both kinds the rate of good ones decides.
    """
    common.small_batches(spark)
    measured = common.materialise(quality.with_features(docs.select("doc_id", "text")), "features")
    model = quality.fit(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = common.unused(docs, "_score")
    return quality.score_texts(docs, model, out=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts that are equal without white space; null counts as empty.

    The longest stays, of these the smallest id (null last), of repeated rows the first in the files.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the smallest id (null last), of repeated rows the first.

    Texts without words, null ones among them, are near-duplicates of each other.
    """
    common.small_batches(spark)
    return simhash.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mask in the place of every secret; all documents stay, and n_chars follows the text.

    A null text stays null. Each row is scanned by itself, so repeated rows stay repeated.
    """
    spans = common.unused(docs, "_findings")
    found = secrets.scan_secrets(docs, out=spans)
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col(spans)))
    return clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(spans)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into sequences of at most 2048 tokens: one row per piece.

    A null or empty text is one piece, of the end token only; repeated rows get pieces and places of their own.
    """
    common.small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
