"""Benchmark decontamination by winnowing, with column expressions only.

A text's k-grams of words are hashed, and of every window of so many k-grams as fit ``span`` words the least hash is
kept. Two texts that share ``span`` words in a row keep the same hash for them, wherever they stand, so a join of the kept
hashes misses no shared span; what it finds is then held word by word against the items' windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_jobs.llm.common import join_counted, let, materialise, sieve, with_locator

#: What separates words: all of ASCII but digits and letters, the latter in lower case by then.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a k-gram; shorter spans are one k-gram.
GRAM = 5
_WINDOWS = "array<struct<start:int,length:int,print:bigint,window:string>>"
_SPANS = "array<struct<start:int,end:int>>"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, _BETWEEN), ""), F.array().cast("array<string>"))


def _kept(hashes: Column, span: int) -> Column:
    """The least k-gram hash of every ``span`` words, in order, of the words' hashes; none where there are fewer words."""
    k = min(GRAM, span)
    w = span - k + 1

    def runs(xs: Column, n: int, of) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(xs) - n), lambda i: of(*(F.get(xs, i + j) for j in range(n))))

    least = (lambda gs: gs) if w == 1 else (lambda gs: runs(gs, w, F.least))
    return F.when(F.size(hashes) >= span, let(runs(hashes, k, F.xxhash64), least)).otherwise(F.array().cast("array<bigint>"))


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def fingerprints(ws: Column, spans: Sequence[int]) -> Column:
    """The distinct kept hashes of a text's words, for all of the spans."""
    return let(_hashes(ws), lambda hs: F.array_distinct(F.concat(*(_kept(hs, span) for span in spans))))


def _windows(ws: Column, spans: Sequence[int], wanted: Column | None = None) -> Column:
    """(start, length, print, window) of every ``span`` words in a row, or of those whose kept hash is in ``wanted``."""
    none = F.array().cast(_WINDOWS)

    def of(hs: Column, span: int) -> Column:
        def windows(kept: Column) -> Column:
            starts = F.sequence(F.lit(0), F.size(kept) - 1)
            some = starts if wanted is None else F.filter(starts, lambda i: F.array_contains(wanted, F.get(kept, i)))
            found = F.transform(some, lambda i: F.struct(i.alias("start"), F.lit(span).alias("length"), F.get(kept, i).alias("print"), F.array_join(F.slice(ws, i + 1, span), " ").alias("window")))
            return F.when(F.size(kept) > 0, found).otherwise(none)

        return let(_kept(hs, span), windows)

    return let(_hashes(ws), lambda hs: F.concat(*(of(hs, span) for span in spans)))


def _merged(spans: Column) -> Column:
    """Sorted (start, end) with overlapping and touching ones made one."""
    none = F.array().cast(_SPANS)

    def closed(a: Column) -> Column:
        return F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))

    def step(a: Column, x: Column) -> Column:
        on = F.coalesce(x["start"] <= a["open"]["end"], F.lit(False))
        grown = F.struct(F.when(on, a["open"]["start"]).otherwise(x["start"]).alias("start"), F.when(on, F.greatest(a["open"]["end"], x["end"])).otherwise(x["end"]).alias("end"))
        return F.struct(grown.alias("open"), F.when(on, a["done"]).otherwise(closed(a)).alias("done"))

    return F.aggregate(spans, F.struct(F.get(none, F.lit(0)).alias("open"), none.alias("done")), step, closed)


def contamination(docs: DataFrame, items: DataFrame, span: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(``id_col``, n_words, spans, items) for every row of ``docs``.

    ``spans`` are the stretches of words (start, end exclusive) that lie in any ``span`` words in a row of an item, or in
    the whole of an item of fewer words; ``items`` the ids, as text, of the items found so, sorted, each once.

    A null or empty text has no words and hits nothing, an item without words is never hit, a null item id counts as empty
    text. Repeated rows of ``docs`` give repeated results; repeated items (or ids) count once. Texts of any length are
    read whole. Empty tables give no rows, or documents without hits. Other columns aren't read, whatever their names.

    Kept hashes of items go to every task up to ``broadcast_bytes``, beyond that a bitmap of them. Only texts with a kept
    hash of an item are read again; their windows meet the items' by the words themselves. Windows that many texts
    share aren't shuffled (see join_counted).
    """
    asked = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(item_text_col)).alias("ws")).where(F.size("ws") > 0)
    lengths = sorted(r[0] for r in asked.select(F.least(F.size("ws"), F.lit(span))).distinct().collect())  # span of them at most
    located = with_locator(docs.select(id_col, text_col))
    prints_of = F.array().cast("array<bigint>") if not lengths else fingerprints(F.col("_ws"), lengths)
    base = materialise(located.select("_locator", id_col, words(F.col(text_col)).alias("_ws")).select("_locator", id_col, F.size("_ws").cast("long").alias("n_words"), prints_of.alias("_prints")), "fingerprints")
    result = base.select("_locator", id_col, "n_words")
    nothing = (F.array().cast(_SPANS), F.array().cast("array<string>"))
    if not lengths:
        return result.select(id_col, "n_words", nothing[0].alias("spans"), nothing[1].alias("items"))
    each = F.concat(*(F.when(F.least(F.size("ws"), F.lit(span)) == n, _windows(F.col("ws"), [n])).otherwise(F.array().cast(_WINDOWS)) for n in lengths))
    known = materialise(asked.select("item", F.explode(each).alias("w")).select("item", "w.print", "w.window").distinct(), "item-windows")

    prints = known.select(F.col("print").alias("_print")).distinct()
    n = prints.count()
    of = base.select("_locator", F.explode("_prints").alias("_print"))
    if n * 16 > broadcast_bytes:
        of, _ = sieve(of, "_print", prints, n)
        shared = of.join(prints, "_print", "left_semi")
    else:
        shared = of.join(F.broadcast(prints), "_print", "left_semi")
    hits = materialise(shared.groupBy("_locator").agg(F.collect_list("_print").alias("_wanted")), "hits")
    maybe, _ = sieve(located, "_locator", hits.select("_locator"), hits.count())
    near = maybe.join(hits, "_locator").select("_locator", "_wanted", words(F.col(text_col)).alias("_ws"))
    found = materialise(near.select("_locator", F.explode(_windows(F.col("_ws"), lengths, F.col("_wanted"))).alias("w")).select("_locator", "w.start", "w.length", "w.window"), "windows")
    counts = found.groupBy("window").agg(F.count("*").alias("n"))
    keyed = materialise(known.select("window", "item").join(counts, "window").groupBy("window").agg(F.collect_set("item").alias("items"), F.first("n").alias("n")), "windows-hit")
    joined = materialise(join_counted(found, keyed, "window", "n").select("_locator", "start", (F.col("start") + F.col("length")).alias("end"), "items"), "exact-hits")
    spans = joined.groupBy("_locator").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s")).select("_locator", _merged(F.col("s")).alias("spans"))
    names = joined.select("_locator", F.explode("items").alias("item")).distinct().groupBy("_locator").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = result.join(materialise(spans.join(names, "_locator"), "contaminated"), "_locator", "left")
    return out.select(id_col, "n_words", *(F.coalesce(name, none).alias(name) for name, none in zip(("spans", "items"), nothing, strict=True)))
