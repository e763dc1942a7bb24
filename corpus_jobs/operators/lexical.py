"""BM25 over an inverted index, for a table of queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_jobs.functions.text import lexical_document, lexical_tokens, term_counts, tokens_of
from corpus_jobs.operators import blocks
from corpus_jobs.operators.bitmaps import rows_of
from corpus_jobs.sources.shared import materialise

CHUNK = ("slug", "chunk_index")


def tokenized(chunks: DataFrame) -> DataFrame:
    """(slug, chunk_index, tokens) of chunks (slug, chunk_index, title, heading, text)."""
    return chunks.select(*CHUNK, lexical_tokens(lexical_document(F.col("title"), F.col("heading"), F.col("text"))).alias("tokens"))


def lexical_index(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, slug, chunk_index, tf, doc_len), counted within each row; with ``terms`` (term, distinct) only those."""
    rows = tokens.select(*CHUNK, F.size("tokens").alias("doc_len"), F.explode(term_counts(F.col("tokens"))).alias("t"))
    rows = rows.select("t.term", *CHUNK, "t.tf", "doc_len")
    return rows if terms is None else rows.join(terms, "term", "left_semi")


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: how many chunks there are, and their mean length in tokens; chunks without tokens count."""
    return tokens.agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avg_len"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df): in how many chunks a term is."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, text)."""
    rows = queries.select("query_id", F.explode(lexical_tokens(F.col("text"))).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def term_statistics(tokens: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What corpus_stats and document_frequencies give, the latter for ``terms``, from one pass over the tokens."""
    wanted = terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))
    return statistics_of(_totals(_signed(tokens, 1).join(wanted, "term", "left_semi")))


def documents(chunks: DataFrame) -> DataFrame:
    """(slug, chunk_index, document) of chunks (slug, chunk_index, title, heading, text), for what counts terms in batches."""
    return chunks.select(*CHUNK, lexical_document(F.col("title"), F.col("heading"), F.col("text")).alias("document"))


def _text(rows: DataFrame) -> str:
    return "tokens" if "tokens" in rows.columns else "document"


def _tokens(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, token) of a batch of documents, or of lists of their tokens."""
    if pa.types.is_string(column.type):
        return tokens_of(column.to_pylist())
    return pc.list_parent_indices(column).to_numpy().astype(np.int64), pc.list_flatten(column)


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    """(term, df, size) for every term of a batch of chunks, and for the empty term, which no text has: its chunks, and their tokens."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.small(batches, 4096):
            row, tokens = _tokens(batch.column(0))
            words = tokens.dictionary_encode()
            of, n = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            df = np.bincount(np.unique(row * n + of) % max(1, n), minlength=n)
            counts = (sign * np.append(x, every).astype(np.int64) for x, every in ((df, batch.num_rows), (np.bincount(of, minlength=n), len(of))))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.dictionary, pa.array([""], pa.string())]), *map(pa.array, counts)], names=["term", "df", "size"])

    return rows.select(_text(rows)).mapInArrow(counted, "term string, df bigint, size bigint")


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size")).where("df != 0 OR size != 0")


def term_totals(tokens: DataFrame) -> DataFrame:
    """(term, df, size): in how many chunks a term is, and how often in all; under the empty term, the chunks and their tokens.

    A table to keep: moved_totals follows a changing corpus with it, statistics_of reads off what a search needs. It is
    made of tokenized chunks or of their documents.
    """
    return _totals(_signed(tokens, 1))


def moved_totals(totals: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """``totals`` after some chunks have gone and others have come (tokens or documents of both): only these are counted."""
    return _totals(totals.select("term", "df", "size").unionByName(_signed(gone, -1)).unionByName(_signed(come, 1)))


def document_changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gone, come): the chunks of two states (slug, chunk_index, title, heading, text) whose indexed text isn't the same in the other.

    Keys and digests meet; texts stay where they are read until it is known whose are needed.
    """
    def keyed(chunks: DataFrame) -> DataFrame:
        document = lexical_document(F.col("title"), F.col("heading"), F.col("text"))
        return chunks.withColumn("_key", F.sha2(F.to_json(F.struct(*CHUNK, document.alias("document"))), 256))

    old, new = keyed(before), keyed(after)
    keys = [materialise(side.select("_key").distinct(), "document-keys") for side in (old, new)]
    only = [materialise(a.join(b, "_key", "left_anti"), "changed-keys") for a, b in (keys, keys[::-1])]
    return tuple(rows_of(side, "_key", some).drop("_key") for side, some in zip((old, new), only, strict=True))


def statistics_of(totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What corpus_stats and document_frequencies give, out of term totals."""
    every = totals.where("term = ''").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n_chunks"), F.coalesce(F.max(F.col("size") / F.col("df")), F.lit(0.0)).alias("avg_len"))
    return every, totals.where("term != ''").select("term", "df")


def bm25_scores(terms: DataFrame, postings: DataFrame, stats: DataFrame, frequencies: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, slug, chunk_index, score) of every chunk that shares a term with a query; repeated query terms count repeatedly.

    ``terms`` is (query_id, term, qtf), ``frequencies`` (term, df), ``stats`` one row. The statistics go to the query
    terms, which are far fewer than the postings; sums are partial before the shuffle.
    """
    n, df, tf = F.col("n_chunks"), F.col("df"), F.col("tf")
    mean = F.when(F.col("avg_len") == 0, F.lit(1.0)).otherwise(F.col("avg_len"))
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    asked = terms.join(frequencies, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("qtf") * idf).alias("weight"), mean.alias("mean"))
    part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / F.col("mean")))
    return postings.join(asked, "term").groupBy("query_id", *CHUNK).agg(F.sum(part).alias("score"))


def matched_terms(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(slug, chunk_index, doc_len, terms, tf) of every row (slug, chunk_index, document or its tokens): how often it has which terms of ``vocabulary``, by their numbers."""
    words = pa.array(vocabulary, pa.string())

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.small(batches):
            row, tokens = _tokens(batch.column(2))
            lengths = np.bincount(row, minlength=batch.num_rows).astype(np.int32)
            terms = pc.index_in(tokens, value_set=words)
            known = pc.is_valid(terms)
            row, terms = row[known.to_numpy(zero_copy_only=False)], pc.filter(terms, known).to_numpy().astype(np.int64)
            keys, tf = np.unique(row * len(vocabulary) + terms, return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(keys // max(1, len(vocabulary)), minlength=batch.num_rows)))).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % max(1, len(vocabulary)), tf))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths), *lists], names=["slug", "chunk_index", "doc_len", "terms", "tf"])

    return rows.select(*CHUNK, _text(rows)).mapInArrow(matched, "slug string, chunk_index int, doc_len int, terms array<int>, tf array<int>")


def _with_titles(matched: DataFrame, titles: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``matched`` of chunks without titles, with what the titles (slug, title) of their slugs add; other slugs' chunks go."""
    heads = matched_terms(titles.select("slug", F.lit(0).alias("chunk_index"), F.col("title").alias("document")), vocabulary).select("slug", F.col("doc_len").alias("_len"), F.col("terms").alias("_terms"), F.col("tf").alias("_tf"))
    return matched.join(heads, "slug").select(*CHUNK, (F.col("doc_len") + F.col("_len")).alias("doc_len"), F.concat("terms", "_terms").alias("terms"), F.concat("tf", "_tf").alias("tf"))


def _postings_with_titles(body: DataFrame, titles: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings of ``terms``, corpus_stats) of chunks whose titles (slug, tokens) stand apart; only keys, terms and counts are shuffled."""
    sizes = materialise(body.select(*CHUNK, F.size("tokens").alias("_n")).join(titles.select("slug", F.size("tokens").alias("_t")), "slug").select(*CHUNK, (F.col("_n") + F.col("_t")).alias("doc_len")), "lengths")
    own = lexical_index(body, terms).select("term", *CHUNK, "tf")
    heads = lexical_index(titles.select("slug", F.lit(0).alias("chunk_index"), "tokens"), terms).select("term", "slug", "tf").join(sizes.select(*CHUNK), "slug").select("term", *CHUNK, "tf")
    postings = own.unionByName(heads).groupBy("term", *CHUNK).agg(F.sum("tf").alias("tf")).join(sizes, list(CHUNK))
    return postings, sizes.agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len"))


def _parts(batch: pa.RecordBatch, terms: int, mean: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, what it adds to a score but for its weight) of a batch of matched terms."""
    rows, own = pc.list_parent_indices(batch.column(3)).to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()
    # a term may be there twice, from a chunk's title and from its text
    keys, of = np.unique(rows * terms + own, return_inverse=True)
    rows, own = np.divmod(keys, max(1, terms))
    tf, length = np.bincount(of, batch.column(4).flatten().to_numpy(), len(keys)), batch.column(2).to_numpy()[rows]
    return rows, own, tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _best_of_tasks(matched: DataFrame, sums: blocks.BoundedSums, ids: pa.Array, kind: str, mean: float, k: int, k1: float, b: float) -> DataFrame:
    """Every task's k best chunks for every query, once at its end."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = blocks.Best(sums.queries, k)
        for batch in blocks.small(batches):
            sums.offer(kept, *_parts(batch, sums.terms, mean, k1, b), batch.column(0).to_pylist(), batch.column(1).to_numpy(), blocks.in_order(batch.column(0), batch.column(1)))
        query, slugs, numbers, key = kept.found()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array(slugs, pa.string()), pa.array(numbers, pa.int32()), pa.array(-key)], names=["query_id", "slug", "chunk_index", "score"])

    return matched.mapInArrow(best, f"query_id {kind}, slug string, chunk_index int, score double")


def _scores_of_rows(matched: DataFrame, entries: blocks.Entries, terms: int, ids: pa.Array, kind: str, mean: float, k1: float, b: float) -> DataFrame:
    """The scores of all chunks for all queries they share a term with, made where the chunks are read."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.small(batches):
            rows, own, part = _parts(batch, terms, mean, k1, b)
            for queries, wanted, weights in entries.blocks():
                score = blocks.dense(rows, own, part, batch.num_rows, wanted) @ weights
                row, query = np.nonzero(score)  # what a term adds is positive
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query + queries.start)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(score[row, query])], names=["query_id", "slug", "chunk_index", "score"])

    return matched.mapInArrow(scored, f"query_id {kind}, slug string, chunk_index int, score double")


def _size(terms: DataFrame) -> int:
    return terms.agg(F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0))).first()[0]


def _weighed(terms: DataFrame, chunks: DataFrame, titles: DataFrame | None = None) -> tuple[DataFrame, tuple, pa.Array, float]:
    """(matched terms of the chunks, written; numbers of queries, numbers of terms, weights, and how many of both; ids of the queries; mean length)."""
    asked = terms.toArrow()
    words, ids = asked["term"].combine_chunks().dictionary_encode(), asked["query_id"].combine_chunks().dictionary_encode("encode")
    vocabulary = words.dictionary.to_pylist()
    matched = matched_terms(documents(chunks), vocabulary)
    matched = materialise(matched if titles is None else _with_titles(matched, titles, vocabulary), "matched-terms")
    count, mean = matched.agg(F.count("*"), F.avg("doc_len")).first()
    found = matched.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count("*").alias("df")).toPandas()
    df = np.zeros(len(words.dictionary))
    df[found["t"].to_numpy(np.int64)] = found["df"]
    idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
    term = words.indices.to_numpy().astype(np.int64)
    weight = np.where(df[term] > 0, asked["qtf"].to_numpy() * idf[term], 0.0)
    return matched, (ids.indices.to_numpy().astype(np.int64), term, weight, len(ids.dictionary), len(words.dictionary)), ids.dictionary, mean or 1.0


def score_lexical(queries: DataFrame, chunks: DataFrame, k1: float = 1.5, b: float = 0.75, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """What bm25_scores gives for queries (query_id, text) over chunks (slug, chunk_index, title, heading, text).

    Query terms of ``broadcast_bytes`` or fewer go to every task, and a chunk's scores are summed where its terms are
    counted: neither postings nor scores, of which there are up to queries times chunks, are shuffled. More query terms
    meet the postings in a join.
    """
    kind, terms = queries.schema["query_id"].dataType.simpleString(), query_terms(queries)
    size = _size(terms)
    if not size:
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, slug string, chunk_index int, score double")
    if size > broadcast_bytes:
        tokens, distinct = tokenized(materialise(chunks, "chunks")), terms.select("term").distinct()
        stats, frequencies = term_statistics(tokens, distinct)
        return bm25_scores(terms, lexical_index(tokens, distinct), stats, frequencies, k1, b)
    matched, (query, term, weight, n_queries, n_terms), ids, mean = _weighed(terms, chunks)
    return _scores_of_rows(matched, blocks.Entries(query, term, weight, n_queries), n_terms, ids, kind, mean, k1, b)


def rank_lexical(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, broadcast_bytes: int = 32 << 20, titles: DataFrame | None = None) -> DataFrame:
    """(query_id, slug, chunk_index, score, rank): the k best chunks of each query; scores of 0 and k <= 0 give no rows.

    Ties (scores rounded to 10 digits) go to the smaller slug, then chunk_index. Query terms of ``broadcast_bytes`` or
    fewer go to every task: the corpus is tokenised once into a narrow table of the query terms that each chunk has,
    which gives the statistics and then each task's k best by sparse sums with bounds (see blocks.BoundedSums), so no
    postings are shuffled. More query terms meet the postings in a join; the corpus is then tokenised twice.

    With ``titles`` (slug, title, a row each) chunks need no title, and those of other slugs take no part. Titles meet
    counts of terms then, so that no text is shuffled.
    """
    if titles is not None:
        chunks = chunks.select(*CHUNK, F.lit("").alias("title"), "heading", "text")
    terms = query_terms(queries)
    kind = queries.schema["query_id"].dataType.simpleString()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *CHUNK)
    size = _size(terms) if k > 0 else 0
    if not size:
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, slug string, chunk_index int, score double, rank int")
    if size > broadcast_bytes:
        tokens, distinct = tokenized(chunks), terms.select("term").distinct()
        if titles is None:
            stats, frequencies = term_statistics(tokens, distinct)
            postings = lexical_index(tokens, distinct)
        else:
            heads = titles.select("slug", lexical_tokens(F.col("title")).alias("tokens"))
            postings, stats = _postings_with_titles(tokens, heads, distinct)
            postings = materialise(postings, "postings")
            frequencies = document_frequencies(postings)
        scores = bm25_scores(terms, postings, stats, frequencies, k1, b).withColumn("score", F.round("score", 10)).where("score > 0")
    else:
        matched, weights, ids, mean = _weighed(terms, chunks, titles)
        scores = _best_of_tasks(matched, blocks.BoundedSums(*weights), ids, kind, mean, k, k1, b)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
