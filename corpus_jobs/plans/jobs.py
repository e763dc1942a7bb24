"""The composite jobs: note sync, chunk sync, hybrid search and its widening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_jobs.functions.text import chunk_hash
from corpus_jobs.operators import lexical, vectors
from corpus_jobs.operators.bitmaps import rows_of
from corpus_jobs.operators.embed import Loader, embed_once
from corpus_jobs.operators.fusion import reciprocal_rank_fusion
from corpus_jobs.operators.notes import chunk_notes, embeddable_notes, visible_notes
from corpus_jobs.operators.sync import KEYS, changed_chunks, sync_counts
from corpus_jobs.operators.tags import wanted_tags
from corpus_jobs.params import Chunking, Embedding, Ranking
from corpus_jobs.schemas import CHUNKS
from corpus_jobs.sources.files import parse_notes
from corpus_jobs.sources.shared import materialise

#: So many hits (keys, ranks and scores of them) go to every task.
FEW = 100_000


def sync_notes(files: DataFrame, root: str, stored: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The new notes snapshot for a tree of files (path, raw), and one row with their number; notes without a file go.

    What upsert_notes and delete_stale_notes give together is one join from the files' side. Of the stored table it
    reads the slugs, the dates of creation and what columns the files don't give.
    """
    incoming = parse_notes(files, root)
    others = [c for c in stored.columns if c not in incoming.columns and c not in ("created_at", "updated_at")]
    both = stored.select("slug", "created_at", *others).join(incoming, "slug", "right")
    times = {"created_at": F.coalesce("created_at", now), "updated_at": now}
    return both.withColumns(times).select(*stored.columns), files.agg(F.count("*").alias("seeded"))


def check_embedding_dim(stored: DataFrame, dim: int, stats: DataFrame | None = None) -> DataFrame:
    """``stored``, or no rows of it if one of its vectors has another size.

    With what was observed when it was written (see tables.write_chunks) no vector is read for that. A snapshot of
    which nothing was observed is looked through.
    """
    seen = None if stats is None else stats.first()
    if seen is None:
        other = stored.where(F.size("embedding") != dim).limit(1).count()
    else:
        other = seen["least_dim"] is not None and (seen["least_dim"] != dim or seen["greatest_dim"] != dim)
    return stored.limit(0) if other else stored


def note_digest(embedding: Embedding, chunking: Chunking) -> Column:
    """Fingerprint of all that a note's chunks and their hashes follow from."""
    return F.sha2(F.to_json(F.struct("title", "heading", "content_html", F.lit(embedding.model).alias("model"), F.lit(chunking.min_section).alias("least"), F.lit(chunking.max_piece).alias("most"))), 256)


def _marks(chunks: DataFrame) -> DataFrame:
    """(slug, n, mark): how many chunks of a note there are, and a fingerprint of their numbers and hashes."""
    return chunks.groupBy("slug").agg(F.count("*").alias("n"), F.sum(F.xxhash64("chunk_index", "content_hash").cast("decimal(38,0)")).alias("mark"))


#: What is known of the notes of a chunks snapshot: the digest of the note, how many chunks it gave, and their mark.
DIGESTS = "slug string, digest string, n bigint, mark decimal(38,0)"


def sync_changed_notes(
    notes: DataFrame, stored: DataFrame, known: DataFrame | None, load: Loader, now: Column, embedding: Embedding = Embedding(), chunking: Chunking = Chunking(), stats: DataFrame | None = None, vectors_at: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new chunks snapshot, one row (embedded, unchanged), and the new digests, which the next sync gets as ``known``.

    A note whose digest is known, and whose stored chunks are those that it gave then, is neither parsed nor chunked;
    its rows stay. Other notes are chunked once, into a written table; of their chunks those with the stored hash keep
    the stored row. Each text that is left goes to the model once (see embed_once, whose store is ``vectors_at``). Chunks
    of notes that aren't published any more, and tails, fall away. Of stored rows only keys and hashes are shuffled, and
    whole rows of changed notes. ``stats`` is what was observed of the stored snapshot.
    """
    spark = notes.sparkSession
    kept = check_embedding_dim(stored, embedding.dim, stats)
    current = embeddable_notes(notes).select("slug", "title", "heading", "content_html", note_digest(embedding, chunking).alias("digest"))
    if known is None:
        same_notes = spark.createDataFrame([], DIGESTS)
    else:
        there = _marks(kept).select("slug", F.col("n").alias("_n"), F.col("mark").alias("_mark"))
        nothing = F.lit(0).cast("decimal(38,0)")
        whole = known.join(there, "slug", "left").where((F.col("n") == F.coalesce("_n", F.lit(0))) & F.col("mark").eqNullSafe(F.coalesce("_mark", nothing)))
        same_notes = materialise(current.select("slug", "digest").join(whole.select("slug", "digest", "n", "mark"), ["slug", "digest"]), "unchanged-notes")
    changed = current if known is None else current.join(same_notes.select("slug"), "slug", "left_anti")
    new = materialise(chunk_notes(changed, chunking).withColumn("content_hash", chunk_hash(F.col("text"), embedding.model)), "new-chunks")
    changes = materialise(changed_chunks(new.select(*KEYS, "content_hash"), kept).select(*KEYS, "is_changed"), "changes")

    pending = new.join(changes.where("is_changed").select(*KEYS), list(KEYS), "left_semi").repartition(F.xxhash64(*KEYS))
    embedded = embed_once(pending, "text", "content_hash", load, embedding.dim, "passage", embedding.batch_size, vectors_at).withColumn("updated_at", now)
    same = changes.where(~F.col("is_changed")).select(*KEYS)
    columns = [f.name for f in CHUNKS.fields]
    stays = [rows_of(kept, "slug", same).join(same, list(KEYS), "left_semi")] + ([] if known is None else [rows_of(kept, "slug", same_notes)])
    snapshot = embedded.select(*columns)
    for part in stays:
        snapshot = snapshot.unionByName(part.select(*columns))

    counts = sync_counts(changes).crossJoin(same_notes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n")))
    counts = counts.select("embedded", (F.col("unchanged") + F.col("_n")).alias("unchanged"))
    given = (F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("mark", F.lit(0).cast("decimal(38,0)")).alias("mark"))
    digests = changed.select("slug", "digest").join(_marks(new), "slug", "left").select("slug", "digest", *given)
    return snapshot, counts, same_notes.select("slug", "digest", "n", "mark").unionByName(digests)


def sync_chunks(notes: DataFrame, stored: DataFrame, load: Loader, now: Column, embedding: Embedding = Embedding(), chunking: Chunking = Chunking()) -> tuple[DataFrame, DataFrame]:
    """The new chunks snapshot, and one row (embedded, unchanged), where nothing is known of the notes but their stored chunks.

    Its keys are those of the published notes' chunks as they are now, so tails and stale notes fall away by
    themselves. Chunks with the stored hash keep the stored row. See sync_changed_notes.
    """
    return sync_changed_notes(notes, stored, None, load, now, embedding, chunking)[:2]


def shown_notes(notes: DataFrame, as_of: str) -> DataFrame:
    """(slug, title, url, tags) of the visible notes, written, as searches read them several times.

    A search and its widening may share it (their ``shown``).
    """
    return materialise(visible_notes(notes, as_of).select("slug", "title", "url", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")), "visible-notes")


def hybrid_search(queries: DataFrame, chunks: DataFrame, notes: DataFrame, as_of: str, params: Ranking = Ranking(), broadcast_bytes: int = 32 << 20, embeddings: DataFrame | None = None, shown: DataFrame | None = None) -> DataFrame:
    """The fused best hits of queries (query_id, text, embedding) over visible chunks: rank, score, distance and the chunk's text.

    Which chunks are visible is told where they are read (see bitmaps.rows_of); the searches shuffle keys, distances
    and counts of terms, and texts only of what was found. Up to ``broadcast_bytes`` of slugs, vectors or query terms go
    to every task; see the searches for what they do beyond. ``embeddings`` (slug, chunk_index, embedding) are vectors
    that stand apart; chunks need none then.
    """
    shown = shown_notes(notes, as_of) if shown is None else shown
    visible = rows_of(chunks, "slug", shown, broadcast_bytes)
    placed = visible if embeddings is None else rows_of(embeddings.where(F.col("embedding").isNotNull()), "slug", shown, broadcast_bytes)
    depth = params.depth if params.top_k > 0 else 0
    semantic = vectors.semantic_top_k(queries, placed, depth, broadcast_bytes)
    ranked = lexical.rank_lexical(queries, visible, depth, params.k1, params.b, broadcast_bytes, shown.select("slug", "title"))
    hits = reciprocal_rank_fusion(semantic, ranked, params.top_k, params.rrf_k, params.semantic_weight, params.lexical_weight)
    return _with_texts(hits, chunks, shown, broadcast_bytes)


def _with_texts(hits: DataFrame, chunks: DataFrame, shown: DataFrame, broadcast_bytes: int, *others: str) -> DataFrame:
    """``hits`` (slug, chunk_index and what else) with the chunks' columns but their vectors, and their notes' title, url and ``others``.

    Only chunks of hits leave the place where they are read.
    """
    kept = materialise(hits, "hits")
    few = kept.count() <= FEW
    wanted = shown.select("slug", "title", "url", *others)
    if few:
        wanted = wanted.join(F.broadcast(kept.select("slug").distinct()), "slug", "left_semi")
    named = kept.join(wanted, "slug")
    rows = chunks.select(*(c for c in chunks.columns if c != "embedding"))
    if few:
        return rows.join(F.broadcast(named), list(KEYS))
    return rows_of(rows, "slug", kept.select("slug"), broadcast_bytes).join(named, list(KEYS))


def expand_neighbors(queries: DataFrame, hits: DataFrame, chunks: DataFrame, notes: DataFrame, as_of: str, k: int, broadcast_bytes: int = 32 << 20, embeddings: DataFrame | None = None, shown: DataFrame | None = None) -> DataFrame:
    """The k nearest chunks of notes that share tags with a query's hits, with the tags they share.

    Chunks are scored where they are read, by queries with the tags they want and their hits, which go to every task or
    to files (see vectors.tagged_top_k). Of the corpus only chunks of notes with a wanted tag take part; those notes'
    tags go to every task up to ``broadcast_bytes``, beyond that they meet the chunks' keys and vectors in a join. Texts
    are joined to what was found. ``embeddings`` (slug, chunk_index, embedding), with a row for every chunk, are vectors
    that stand apart.
    """
    shown = shown_notes(notes, as_of) if shown is None else shown
    hit = materialise(hits.select("query_id", "slug").distinct(), "hit-slugs")
    wanted = materialise(wanted_tags(hit, shown), "wanted-tags")
    # tags that nobody wants would only make the rows wider
    own = shown.select("slug", F.explode("tags").alias("tag")).join(wanted.select("tag").distinct(), "tag")
    tagged = materialise(own.groupBy("slug").agg(F.collect_set("tag").alias("tags")), "notes-near")
    size = tagged.agg(F.coalesce(F.sum(F.octet_length("slug") + F.octet_length(F.array_join("tags", "")) + 8 * F.size("tags") + 16), F.lit(0))).first()[0]
    vectors_of = (chunks if embeddings is None else embeddings).select(*KEYS, "embedding")
    candidates = vectors_of.join(F.broadcast(tagged), "slug") if size <= broadcast_bytes else rows_of(vectors_of, "slug", tagged, broadcast_bytes).join(tagged, "slug")
    found = vectors.tagged_top_k(queries, wanted, hit, candidates, k, broadcast_bytes)
    wants = wanted.groupBy("query_id").agg(F.collect_set("tag").alias("_wanted"))
    shared = _with_texts(found, chunks, shown, broadcast_bytes, "tags").join(wants, "query_id")
    return shared.withColumn("shared_tags", F.array_intersect("tags", "_wanted")).drop("tags", "_wanted")
