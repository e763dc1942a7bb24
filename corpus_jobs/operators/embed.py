"""Embedding of texts by a model that the caller supplies."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_jobs.operators import blocks
from corpus_jobs.sources.shared import shared_dir

#: Makes, once per worker, what turns (texts, kind) into a list of vectors.
Loader = Callable[[], Callable[[list[str], str], list]]


def hashing_embedder(dim: int) -> Loader:
    """A model for tests: signed word counts hashed into ``dim`` places, of unit length."""
    def load():
        from xxhash import xxh64_intdigest

        @lru_cache(1 << 16)
        def place(word: str) -> tuple[int, int]:
            h = xxh64_intdigest(word.encode())
            return h % dim, 1 if h >> 63 else -1

        def embed(texts: list[str], kind: str) -> list[np.ndarray]:
            out = []
            for text in texts:
                found = np.array([place(word) for word in text.lower().split()], np.int64).reshape(-1, 2)
                v = np.bincount(found[:, 0], found[:, 1], dim)
                v[0] += not v.any()
                out.append((v / np.linalg.norm(v)).astype(np.float32))
            return out

        return embed

    return load


def embed_column(text: Column, load: Loader, dim: int, kind: str = "passage", batch_size: int = 32) -> Column:
    """Vectors of a text column; a null text has none. A vector of another size than ``dim`` is an error."""
    @F.pandas_udf("array<float>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            known = texts[texts.notna()]
            for at in range(0, len(known), batch_size):
                part = known.iloc[at : at + batch_size]
                for i, v in zip(part.index, embed(part.tolist(), kind), strict=True):
                    if len(v) != dim:
                        raise ValueError(f"the model gave a vector of {len(v)} numbers instead of {dim}")
                    out[i] = np.asarray(v, dtype=np.float32)
            yield out

    return embedded(text)


def embed_texts(df: DataFrame, text_col: str, load: Loader, dim: int, kind: str = "passage", batch_size: int = 32, out: str = "embedding") -> DataFrame:
    """``df`` with the vectors of ``text_col``; the model is loaded once per worker."""
    if kind not in ("passage", "query"):
        raise ValueError("kind must be passage or query")
    return df.withColumn(out, embed_column(F.col(text_col), load, dim, kind, batch_size))


_STORED = "{hash} string, {out} array<float>"


def _embedded(embed, texts: list[str], kind: str, dim: int) -> list[np.ndarray]:
    found = [np.asarray(v, dtype=np.float32) for v in embed(texts, kind)]
    for v in found:
        if len(v) != dim:
            raise ValueError(f"the model gave a vector of {len(v)} numbers instead of {dim}")
    return found


def _fill(missing: DataFrame, hash_col: str, text_col: str, out: str, store: str, load: Loader, dim: int, kind: str, batch_size: int, texts_a_file: int) -> int:
    """Embed every row of ``missing`` (hash, text), a file of the store at a time; gives the number of vectors."""
    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem, FileType

        embed = None
        files, base = FileSystem.from_uri(store)
        hashes: list[str] = []
        texts: list[str] = []

        def kept() -> int:
            nonlocal embed, hashes, texts
            # the name follows from the hashes, so that a task that runs again finds what it has finished
            name = hashlib.sha256("\n".join([str(dim), *hashes]).encode()).hexdigest()
            if files.get_file_info(f"{base}/{name}.parquet").type == FileType.NotFound:
                embed = embed or load()
                vectors = [v for at in range(0, len(texts), batch_size) for v in _embedded(embed, texts[at : at + batch_size], kind, dim)]
                table = pa.table({hash_col: pa.array(hashes, pa.string()), out: pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))})
                hidden = f"{base}/_{name}.{os.urandom(8).hex()}"  # readers pass over it
                with files.open_output_stream(hidden) as stream:
                    pq.write_table(table, stream)
                files.move(hidden, f"{base}/{name}.parquet")
            hashes, texts, n = [], [], len(hashes)
            return n

        done = 0
        for batch in blocks.small(batches, texts_a_file):
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes.append(h)
                texts.append(text)
                if len(hashes) >= texts_a_file:
                    done += kept()
        if hashes:
            done += kept()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    return missing.select(hash_col, text_col).mapInArrow(filled, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def embed_once(df: DataFrame, text_col: str, hash_col: str, load: Loader, dim: int, kind: str = "passage", batch_size: int = 32, store: str | None = None, out: str = "embedding", texts_a_file: int = 1024) -> DataFrame:
    """``df`` with the vectors of ``text_col``, by a store of vectors that is addressed by ``hash_col``, the texts' fingerprint for the model.

    Each distinct hash goes to the model once, however many rows have it, and only if ``store`` (a folder in shared
    storage; a new one if not given) doesn't have it. Tasks put finished vectors into the store file by file, of so many
    texts, so a task that runs again, and a job after one that failed, goes on after the last finished file. The store
    may be kept between jobs and used by several. A null text has no vector, and no hash of its own.
    """
    if kind not in ("passage", "query"):
        raise ValueError("kind must be passage or query")
    spark = df.sparkSession
    store = store or shared_dir(spark, "vectors")
    schema = _STORED.format(hash=f"`{hash_col}`", out=f"`{out}`")
    spark.createDataFrame([], schema).write.mode("ignore").parquet(store)
    wanted = df.where(F.col(text_col).isNotNull()).groupBy(hash_col).agg(F.first(text_col).alias(text_col))
    sized = F.size(out) == dim  # vectors of another size are another model's
    missing = wanted.join(spark.read.schema(schema).parquet(store).where(sized).select(hash_col), hash_col, "left_anti")
    _fill(missing, hash_col, text_col, out, store, load, dim, kind, batch_size, texts_a_file)
    known = spark.read.schema(schema).parquet(store).where(sized).dropDuplicates([hash_col])
    vectors = known.select(F.col(hash_col).alias("_hash"), F.col(out).alias("_vector"))
    rows = df.drop(out)
    key = F.when(F.col(text_col).isNotNull(), F.col(hash_col))
    return rows.withColumn("_key", key).join(vectors, F.col("_key") == F.col("_hash"), "left").withColumnRenamed("_vector", out).drop("_key", "_hash")
