"""Phrase collocation mining: one count of padded longest windows, whose shorter phrases are sums over their prefixes.

Every word starts one window of ``longest`` words, cut at the end of its piece and padded from there. A ROLLUP over the
windows' columns sums the windows that begin alike, which gives the occurrences of every phrase of any length at once.
Words travel as 64-bit hashes, which are made sure to be unambiguous for the words that count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_jobs.llm.common import materialise, partitions, small, stretches

#: Ends of pieces, and the one that stands for all of them.
_ENDS, _END = b".,;:!?\n\x0b\x0c\r", b"."
_TO_END = bytes.maketrans(_ENDS, _END * len(_ENDS))
_NO_LANG = "und"
_MARKS = {".": 0, "..": 1}
#: Characters of texts whose words are in memory at once.
_CHARS = 4_000_000


def _spaced(text: str | None) -> bytes:
    """A text in UTF-8, A-Z in lower case, with `` . `` for the ends of its pieces."""
    return (text or "").encode().lower().translate(_TO_END).replace(_END, b" . ")  # of bytes: A-Z only


def tokens(texts: Iterable[str | None]) -> pa.DictionaryArray:
    """The words of texts, with ``.`` between their pieces and ``..`` behind each text; no word holds a ``.``."""
    raw = b"".join(_spaced(text) + b" .. " for text in texts).strip()
    whole = pa.Array.from_buffers(pa.large_utf8(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int64)), pa.py_buffer(raw)])
    # other white space is in none of the pieces
    return pc.list_flatten(pc.ascii_split_whitespace(whole)).dictionary_encode()


class _Hashes(dict):
    """Hashes of words, asked for once; 0 stands for the end of a piece and for words that a bitmap leaves out, 1 for that of a text."""

    def __init__(self, seed: int, bits: int, kept: np.ndarray | None):
        super().__init__(_MARKS)
        self.seed, self.mask, self.kept = seed, (1 << bits) - 1, kept

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word, seed=self.seed) & self.mask
        if self.kept is not None and not self.kept[h % (8 * len(self.kept)) >> 3] >> (h & 7) & 1:
            h = 0
        elif h == 1:
            h = 0  # not a frequent word's, see _vocabulary
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, words: pa.DictionaryArray) -> np.ndarray:
        if len(self) > 1_000_000:
            self.clear()
            self.update(_MARKS)
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        return np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, counted within batches before they are shuffled."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            of_lang: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of_lang.setdefault(lang, []).append(text)
            for lang, texts in of_lang.items():
                for part in stretches(texts, _CHARS):
                    found = tokens(texts[part])
                    counts = pa.array(np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)).astype(np.int64))
                    own = pa.table({"word": found.dictionary.cast(pa.string()), "n": counts}).filter(pc.invert(pc.is_in(found.dictionary, value_set=pa.array(list(_MARKS), found.dictionary.type))))
                    own = own.add_column(0, "lang", pa.array([lang] * len(own), pa.string()))
                    yield from own.combine_chunks().to_batches()

    return docs.mapInArrow(counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _seed(spark, k: int) -> int:
    """The seed that the hash of a second column gets after the number ``k``, unsigned."""
    return spark.range(1).select(F.xxhash64(F.lit(k))).first()[0] % (1 << 64)


def _vocabulary(words: DataFrame, least: int, bits: int) -> tuple[DataFrame, int]:
    """(lang, word, n, h) of words counted (written) that are frequent somewhere, and the seed of a hash that tells these from all others."""
    for k in range(100):
        h = F.xxhash64(F.lit(k), F.col("word")).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        hashed = words.withColumn("h", h)
        # of equal hashes with a frequent word among them, all must be of one word
        clash = hashed.groupBy("h").agg(F.max("n").alias("n"), F.min("word").alias("a"), F.max("word").alias("b")).where((F.col("n") >= least) & ((F.col("a") != F.col("b")) | F.col("h").isin(0, 1)))
        if clash.isEmpty():
            return hashed.where(F.col("n") >= least), _seed(words.sparkSession, k)
    raise ValueError("no seed tells the words' hashes apart")


def _bitmap(keys: DataFrame, column: str, most_bits: int, n: int) -> np.ndarray:
    """A bitmap of ``n`` keys' lowest bits: 64 bits a key, and so many as ``most_bits`` at most; other keys may be in it, too."""
    bits = min(1 << most_bits, 1 << max(15, (64 * n).bit_length()))
    at = F.pmod(F.col(column), F.lit(bits)) + 1  # bitmaps count from 1
    marks = keys.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for b, m in zip(marks["b"].to_pylist(), marks["m"].to_pylist(), strict=True):
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)
    return out


def _lead(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


def _mix(x: np.ndarray, column: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + column.astype(np.uint64) * np.uint64(0x94D049BB133111EB)


def _buckets(langs: np.ndarray, words: np.ndarray, m: int, at: np.ndarray, bits: int) -> np.ndarray:
    """A bucket of ``2 ** bits`` for each run of ``m`` words of a language that starts at one of the places ``at``."""
    x = langs[at]
    for k in range(m):
        x = _mix(x, words[at + k])
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _runs(langs: np.ndarray, words: np.ndarray, longest: int, maps: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """For each length up to ``longest``: where a run of so many words starts, all of whose parts may be frequent by ``maps`` (of runs of 2, 3 and so on)."""
    on = words != 0
    out = [on]
    for m in range(2, longest + 1):
        on = on & _lead(on, 1)
        if m - 2 < len(maps):
            at = np.flatnonzero(on)
            b = _buckets(langs, words, m, at, bits)
            on = np.zeros(len(words), bool)
            on[at[maps[m - 2][b >> 3] >> (b & 7).astype(np.uint8) & 1 == 1]] = True
        out.append(on)
    return out


def _hashed(batch: pa.RecordBatch, hashes: _Hashes) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(languages, number of each word's language, its hash, hash of its language), texts parted by zeros, in stretches."""
    langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for part in stretches(texts, _CHARS):
        names = sorted(set(langs[part]))
        number = {name: i for i, name in enumerate(names)}
        words = hashes.of(tokens(texts[part]))
        ends = words == 1
        own = np.array([number[name] for name in langs[part]])[np.cumsum(ends) - ends]
        words[ends] = 0
        yield names, own, words, np.array([xxhash.xxh64_intdigest(name.encode()) for name in names], np.uint64)[own]


def _run_counts(docs: DataFrame, seed: int, bits: int, kept, m: int, maps: list, bucket_bits: int) -> DataFrame:
    """(bucket, n): how many runs of ``m`` words fall into each bucket, counted within batches before they are shuffled."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, before = _Hashes(seed, bits, kept.value), [x.value for x in maps]
        for batch in small(batches):
            found = []
            for _, _, words, langs in _hashed(batch, hashes):
                at = np.flatnonzero(_runs(langs, words, m, before, bucket_bits)[-1])
                found.append(_buckets(langs, words, m, at, bucket_bits))
            if found:
                buckets, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    return docs.mapInArrow(counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _distinct_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each kind, how many there are) of equally long columns."""
    key = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        key = _mix(key, x)
    order = np.argsort(key)
    starts = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    first, n = order[starts], np.diff(np.append(starts, len(order)))
    like = np.repeat(first, n)
    if any((x[order] != x[like]).any() for x in columns):  # other rows have the same key: sort them whole
        order = np.lexsort(columns)
        starts = np.flatnonzero(np.any([np.diff(x[order], prepend=x[order[0]] + 1) != 0 for x in columns], axis=0))
        first, n = order[starts], np.diff(np.append(starts, len(order)))
    return first, n


def _windows(docs: DataFrame, seed: int, bits: int, kept, maps: list, bucket_bits: int, longest: int) -> DataFrame:
    """(lang, w1 to w<longest>, n): padded windows of hashes and how often each occurs, in batches.

    A window stops at the end of its piece, before a word that isn't frequent, and before a run that can't be.
    """
    names = [f"w{i + 1}" for i in range(longest)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, often = _Hashes(seed, bits, kept.value), [x.value for x in maps]
        for batch in small(batches):
            for langs, own, words, lang_hashes in _hashed(batch, hashes):
                starts = _runs(lang_hashes, words, longest, often, bucket_bits)
                columns = [own, *(np.where(on, _lead(words, i), 0) for i, on in enumerate(starts))]
                alone = starts[0] & ~starts[1] if longest > 1 else starts[0]
                for mask, size in ((alone, 1), (starts[0] & ~alone, longest)):  # most words are alone, and quickly told apart
                    picked = [x[mask] for x in columns[: size + 1]]
                    first, n = _distinct_rows(picked)
                    rows = [x[first] for x in picked[1:]] + [np.zeros(len(first), np.int64)] * (longest - size)
                    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(picked[0][first])), *map(pa.array, rows), pa.array(n.astype(np.int64))], names=["lang", *names, "n"])

    return docs.mapInArrow(counted, f"lang string, {', '.join(f'{n} bigint' for n in names)}, n bigint")


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang", bits: int = 64, bucket_bits: int = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, vocabulary, totals): (lang, words, f) of phrases that occur ``least`` times, as hashes; (lang, word, n, h); (lang, n).

    Shorter runs of frequent words are counted in buckets first, without telling apart what falls into one; where all of
    a bucket occur fewer times, no window needs to hold such a run. That leaves out nothing that counts, and rare runs
    are most of a corpus. A bitmap of the ``2 ** bucket_bits`` buckets for each length (4 MB) and one of the frequent words
    (32 MB at most) go to every task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(_NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    words = materialise(_word_counts(rows), "words")
    vocabulary, seed = _vocabulary(words, least, bits)
    frequent = vocabulary.select("h").distinct()
    kept = spark.sparkContext.broadcast(_bitmap(frequent, "h", 28, frequent.count()))
    maps: list = []
    for m in range(2, longest):
        often = _run_counts(rows, seed, bits, kept, m, maps, bucket_bits).where(F.col("n") >= least).select(F.col("bucket").cast("long").alias("bucket"))
        maps.append(spark.sparkContext.broadcast(_bitmap(often, "bucket", bucket_bits, 1 << bucket_bits)))
    names = [f"w{i + 1}" for i in range(longest)]
    windows = _windows(rows, seed, bits, kept, maps, bucket_bits, longest).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    summed = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    size = F.lit(longest) - F.bit_count("g")  # the grouping id has a bit for each column that is summed over
    end = F.element_at(F.array(*names), F.greatest(size, F.lit(1)))
    found = summed.where((F.col("g") < (1 << longest) - 1) & (F.col("f") >= least) & (end != 0))
    phrases = materialise(found.select("lang", F.slice(F.array(*names), F.lit(1), size).alias("words"), "f"), "phrases")
    return phrases, vocabulary, words.groupBy("lang").agg(F.sum("n").alias("n"))


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, longest: int = 4, share: int = 80, text_col: str = "text", lang_col: str = "lang", bits: int = 64, bucket_bits: int = 25) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words that stick together.

    ``a`` is how often a phrase occurs within pieces, overlaps included, ``least`` times or more; ``l`` and ``r`` are the
    same for its first words and the rest at the cut with the lowest floor(2000000 * a / (l + r)), the score (of equal
    ones the first cut); ``n`` counts the language's words. A phrase goes if it lies in a longer one, dropped or not, that
    occurs ``share`` percent as often. Best score first, then greatest ``a``, then the phrase by its UTF-8 bytes.

    A null text has no words, a null language is ``und``; repeated rows count each. Texts of any length are read
    whole. An empty table gives no rows; other columns aren't read, whatever their names. ``bits`` and ``bucket_bits`` are
    those of phrase_counts.
    """
    phrases, vocabulary, totals = phrase_counts(docs, least, longest, text_col, lang_col, bits, bucket_bits)
    candidates = phrases.where(F.size("words") >= 2).withColumnRenamed("f", "a")
    size = F.size("words")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("*", F.slice("words", F.lit(1), F.col("k")).alias("_first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("_rest"))
    for part, name in (("_first", "l"), ("_rest", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("words").alias(part), F.col("f").alias(name)), ["lang", part])
    scored = cuts.withColumns({"_a": _wide("a") * F.lit(2_000_000), "_lr": _wide("l") + _wide("r")}).withColumn("score", F.expr("_a div _lr"))
    best = scored.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "words", "a", "b.l", "b.r", "b.score")
    places = [(start, length) for length in range(2, longest) for start in range(1, longest - length + 2)]
    parts = F.array_compact(F.array(*(F.when((size > length) & (size >= start + length - 1), F.slice("words", start, length)) for start, length in places)))
    subs = candidates.select("a", "lang", F.explode(parts).alias("words"))
    longer = subs.groupBy("lang", "words").agg(F.max("a").alias("_longer"))
    kept = best.join(longer, ["lang", "words"], "left").where(F.col("_longer").isNull() | (_wide("_longer") * 100 < _wide("a") * share)).drop("_longer")

    spelt = kept.select("lang", "words", F.posexplode("words").alias("_at", "h")).join(vocabulary.select("lang", "h", "word"), ["lang", "h"])
    texts = spelt.groupBy("lang", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = kept.join(texts, ["lang", "words"]).drop("words")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
