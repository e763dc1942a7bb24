"""Language identification by bit-sliced Bloom filters: one lookup gives all languages that hold an n-gram.

Every slot of the filter has a bit per language. The bits that all of an n-gram's slots share are the languages that
hold it, but for false positives, which are taken off the counts at each language's own rate.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_jobs.llm.common import small, stretches, unused

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Languages in one 64-bit slot; more take further slots side by side.
_BITS = 62


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, trigram) for all lower-cased letter trigrams of whole texts; words have a border on either side."""
    codes = [np.frombuffer((" " + x.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    c = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(x) for x in codes])
    c = np.where(_letters()[c], c, 0).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c, of = c[keep], of[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    middle = c[1:-1] != 0
    grams = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    return of[1:-1][middle], grams[middle]


def _slots(grams: np.ndarray, hashes: int, bits: int) -> list[np.ndarray]:
    out = []
    for odd in _ODD[:hashes]:
        h = grams * np.uint64(odd)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_ODD[-1])
        out.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return out


@dataclass
class LanguageFilter:
    """``slots`` has a row per slot and a 64-bit column per 62 languages; ``languages`` is sorted, commonest first."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    bits: int

    def __post_init__(self):
        held = [((self.slots[:, k // _BITS] >> np.uint64(k % _BITS)) & np.uint64(1)).mean() for k in range(len(self.languages))]
        self.false = np.minimum(np.array(held) ** self.hashes, 0.999)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores (0 to 1) of whole texts: ``und`` and 0 for null and for texts without a letter."""
        n, counts = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        owners, parts = _parts([t or "" for t in texts])
        for s in stretches(parts):
            of, grams = trigrams(parts[s])
            of = owners[s][of]
            n += np.bincount(of, minlength=len(texts))
            at = _slots(grams, self.hashes, self.bits)
            for word in range(self.slots.shape[1]):
                mask = self.slots[at[0], word]
                for other in at[1:]:
                    mask &= self.slots[other, word]
                for k in range(word * _BITS, min(len(self.languages), (word + 1) * _BITS)):
                    counts[:, k] += np.bincount(of, (mask >> np.uint64(k % _BITS)) & np.uint64(1), len(texts))
        real = np.maximum(0, (counts - n[:, None] * self.false) / (1 - self.false))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best, total = real.argmax(axis=1), real.sum(axis=1)
        score = np.where(total > 0, real[np.arange(len(texts)), best] / np.where(total > 0, total, 1), 0.0)
        return ["und" if n[i] == 0 else self.languages[b] for i, b in enumerate(best)], score


def _parts(texts: list[str], chars: int = 1_000_000) -> tuple[np.ndarray, list[str]]:
    """(text, part): whole texts, or parts of about so many characters of long ones, which end where a word does."""
    owners, parts = [], []
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = min(at + chars, len(text))
            while end < len(text) and text[end].isalpha():
                end += 1
            owners.append(i)
            parts.append(text[at:end])
            at = max(end, 1)
    return np.array(owners, np.int64), parts


def count_trigrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over whole texts; partial counts are summed in the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                _, own = _parts([t for t, of in zip(texts, langs, strict=True) if of == name])
                for s in stretches(own):
                    grams, n = np.unique(trigrams(own[s])[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    return rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", learn: Column | None = None, least_rate: float = 1e-5, least_share: float = 0.2, hashes: int = 3, bits: int = 18, most_languages: int = 2000) -> LanguageFilter:
    """Learn from all rows with a language (and ``learn`` true); rows with a null text or language teach nothing.

    A language holds a trigram that makes up ``least_rate`` of its trigrams and at least ``least_share`` of the rate
    where it is most common, so strays from other languages don't count; that is at most 1 / least_rate trigrams a
    language. What the driver gets is the filter itself, of 2 ** bits slots; from about 90,000 trigrams a language on it
    fills up, and needs more bits. Repeated rows count each time; other columns are not read. A column of more than
    ``most_languages`` different languages isn't one of languages, and an error.
    """
    rows = docs if learn is None else docs.where(learn)
    counts = count_trigrams(rows, text, lang)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = sorted(((r["total"], r["lang"]) for r in totals.limit(most_languages + 1).collect()), key=lambda x: (-x[0], x[1]))
    if len(sizes) > most_languages:
        raise ValueError(f"the column {lang} has more than {most_languages} different languages")
    languages = [name for _, name in sizes]
    spark = docs.sparkSession
    table = spark.createDataFrame([(name, i, total) for i, (total, name) in enumerate(sizes)], "lang string, k int, total long")
    rated = counts.join(F.broadcast(table), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= least_rate)
    held = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= F.col("top") * least_share).select("gram", "k")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, k = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for slots in _slots(grams, hashes, bits):
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(k // _BITS), pa.array(np.left_shift(np.int64(1), (k % _BITS).astype(np.int64)))], names=["slot", "word", "mask"])

    got = held.mapInArrow(placed, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    slots = np.zeros((1 << bits, max(1, -(-len(languages) // _BITS))), np.uint64)
    slots[got["slot"].to_numpy(np.int64), got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    return LanguageFilter(languages, slots, hashes, bits)


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the text replaced by its predicted language and score; columns of these names are replaced, all others stay.

    A text that is null or has no letter is ``und`` with score 0. Of languages with equal counts the one learned from
    more text wins (then the smaller name). Each row is judged by itself: repeated rows get equal results, an empty
    table stays empty. Whole texts of any length are read, in parts of about a million characters that end with a word.
    """
    others = [c for c in docs.columns if c not in (text, lang_out, score_out)]
    rows = docs.withColumn(unused(docs, "_text"), F.col(text)).drop(text, lang_out, score_out)
    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            k = batch.num_columns - 1
            texts = batch.column(k).to_pylist()
            names, scores = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*others, lang_out, score_out])

    return rows.mapInArrow(predicted, schema)
