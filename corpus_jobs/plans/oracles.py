"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from corpus_jobs.functions.text import SPACE, TOKEN
from corpus_jobs.params import Dialogs
from corpus_jobs.plans.tables import AS_OF, MODEL

_SITE = "https://notes.example"
_FOLD = "lower({0})"
for _ch in "ßſŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ":
    _FOLD = f"replace({_FOLD}, '{_ch}', '{_ch.casefold()}')"


def _tokens(text: str) -> str:
    return f"regexp_extract_all({_FOLD.format(text)}, '{TOKEN}')"


#: What the other statements build on, as common tables.
_WITH = f"""
WITH RECURSIVE notes AS (
    SELECT doc_id, source || '/' || doc_id AS slug, '/notes/' || source || '/' || doc_id || '.html' AS url, 'Doc ' || doc_id AS title, lang, source AS category,
           strftime(DATE '2024-01-01' + (doc_id % 60)::INT, '%Y-%m-%d') AS date, coalesce(quality, 1) = 1 AS published,
           [lang, source] || CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END AS tags, text AS body
    FROM documents LEFT JOIN labels USING (doc_id)),
visible AS (SELECT * FROM notes WHERE published AND date <= '{AS_OF}'),
raw_lines AS (SELECT doc_id, source || '/' || doc_id AS slug, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
    SELECT slug, doc_id, row_number() OVER (PARTITION BY slug ORDER BY i) AS i, l FROM (
        SELECT slug, doc_id, i, trim(regexp_replace(l, '{SPACE}+', ' ', 'g')) AS l FROM (SELECT slug, doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM raw_lines))
    WHERE l <> ''),
packed AS (
    SELECT slug, doc_id, i, l, 0 AS chunk_index, length(l) AS size FROM lines WHERE i = 1
    UNION ALL
    SELECT n.slug, n.doc_id, n.i, n.l, CASE WHEN p.size + 1 + length(n.l) > 2500 THEN p.chunk_index + 1 ELSE p.chunk_index END,
           CASE WHEN p.size + 1 + length(n.l) > 2500 THEN length(n.l) ELSE p.size + 1 + length(n.l) END
    FROM packed p JOIN lines n ON n.slug = p.slug AND n.i = p.i + 1),
chunks AS (SELECT slug, doc_id, chunk_index, 'Doc ' || doc_id AS heading, string_agg(l, chr(10) ORDER BY i) AS text FROM packed GROUP BY slug, doc_id, chunk_index),
shown AS (SELECT c.*, v.title, v.url FROM chunks c JOIN visible v USING (slug)),
tokens AS (SELECT slug, chunk_index, {_tokens("title || ' ' || heading || ' ' || text")} AS ts FROM shown),
postings AS (SELECT term, slug, chunk_index, count(*) AS tf, any_value(doc_len) AS doc_len FROM (SELECT slug, chunk_index, len(ts) AS doc_len, unnest(ts) AS term FROM tokens) GROUP BY term, slug, chunk_index),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n_chunks, coalesce(avg(len(ts)), 0) AS avg_len FROM tokens),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_tokens("text")}) AS term FROM benchmark) GROUP BY query_id, term),
scored AS (
    SELECT query_id, slug, chunk_index, round(sum(qtf * ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_len / CASE WHEN avg_len = 0 THEN 1 ELSE avg_len END))), 10) AS score
    FROM asked JOIN postings USING (term) JOIN freq USING (term), stats GROUP BY query_id, slug, chunk_index),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug, chunk_index) AS rank FROM scored WHERE score > 0) WHERE rank <= 24),
placed AS (SELECT c.*, e.embedding FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id AND c.chunk_index = 0),
questions AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
near AS (SELECT query_id, slug, chunk_index, doc_id, round(list_cosine_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12) AS distance FROM questions q, placed p),
semantic AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, slug, chunk_index) AS rank FROM near) WHERE rank <= 24),
semantic_shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, slug, chunk_index) AS rank FROM near JOIN visible USING (slug)) WHERE rank <= 24),
{{fused}}"""

_FUSED = """{name}_sum AS (
    SELECT query_id, slug, chunk_index, coalesce(max(d), 0) AS distance, round(sum(part), 12) AS score FROM (
        SELECT query_id, slug, chunk_index, 1.0::DOUBLE / (60 + rank) AS part, distance AS d FROM {semantic}
        UNION ALL SELECT query_id, slug, chunk_index, 0.7::DOUBLE / (60 + rank), NULL FROM lexical) GROUP BY query_id, slug, chunk_index),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug, chunk_index) AS rank FROM {name}_sum) WHERE rank <= 6)"""

_TAGS = """
shown_tags AS (SELECT slug, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM visible),
{name}_near AS (
    SELECT query_id, slug, string_agg(tag, ',' ORDER BY pos) AS shared_tags, string_agg(tag, ', ' ORDER BY pos) AS shown_as FROM (
        SELECT DISTINCT w.query_id, t.slug, t.tag, t.pos FROM (SELECT DISTINCT query_id, tag FROM {hits} JOIN shown_tags USING (slug)) w JOIN shown_tags t USING (tag)) x
    WHERE NOT EXISTS (SELECT 1 FROM {hits} h WHERE h.query_id = x.query_id AND h.slug = x.slug) GROUP BY query_id, slug)"""

_RELATED = """
widened AS (
    SELECT * FROM (SELECT query_id, slug, chunk_index, shared_tags, shown_as, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, slug, chunk_index) AS rank
    FROM (SELECT n.query_id, s.slug, s.chunk_index, n.shared_tags, n.shown_as, x.distance
          FROM hits_near n JOIN shown s USING (slug) JOIN questions USING (query_id) LEFT JOIN near x ON x.query_id = n.query_id AND x.slug = s.slug AND x.chunk_index = s.chunk_index)) WHERE rank <= 2),
listed AS (
    SELECT query_id, 0 AS part, rank, slug, chunk_index, '' AS shown_as FROM hits UNION ALL SELECT query_id, 1, rank, slug, chunk_index, shown_as FROM widened),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, slug ORDER BY part, rank) AS r FROM listed) WHERE r = 1),
sources AS (
    SELECT query_id, '{{"sources":[' || string_agg('{{"slug":"' || f.slug || '","title":"' || title || '","url":"{site}' || url || '"}}', ',' ORDER BY part, rank) || ']}}' AS sources_json
    FROM firsts f JOIN visible USING (slug) GROUP BY query_id)"""

_HITS = _FUSED.format(name="hits", semantic="semantic_shown")
_HIT_TAGS = _TAGS.format(name="hits", hits="hits")
_D = Dialogs()
_CHANGES = f"""
known AS (SELECT doc_id, max(toxic) = 1 AS edited FROM documents JOIN labels USING (doc_id) GROUP BY doc_id),
stored AS (
    SELECT slug, chunk_index, sha256('{MODEL}' || chr(0) || CASE WHEN edited THEN 'old ' ELSE '' END || text) AS content_hash FROM chunks JOIN known USING (doc_id)
    UNION ALL SELECT slug, max(chunk_index) + 1, sha256('{MODEL}' || chr(0) || 'gone') FROM chunks JOIN known USING (doc_id) WHERE edited GROUP BY slug),
fresh AS (SELECT slug, chunk_index, sha256('{MODEL}' || chr(0) || text) AS content_hash FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'es')),
changes AS (SELECT f.*, f.content_hash IS DISTINCT FROM s.content_hash AS is_changed FROM fresh f LEFT JOIN stored s USING (slug, chunk_index))"""

#: Chunks of notes of two sections: a document's lines under one heading, and a short section merged into that.
_NOTED = """
body_lines AS (SELECT slug, i, l FROM lines UNION ALL
    SELECT slug, n + j, ['More', 'short', 'tail'][j] FROM (SELECT d.slug, coalesce(max(i), 0) AS n FROM raw_lines d LEFT JOIN lines x USING (slug) GROUP BY d.slug), (SELECT unnest([1, 2, 3]) AS j)),
body_packed AS (
    SELECT slug, i, l, 0 AS chunk_index, length(l) AS size FROM body_lines WHERE i = 1
    UNION ALL
    SELECT n.slug, n.i, n.l, CASE WHEN p.size + 1 + length(n.l) > 2500 THEN p.chunk_index + 1 ELSE p.chunk_index END,
           CASE WHEN p.size + 1 + length(n.l) > 2500 THEN length(n.l) ELSE p.size + 1 + length(n.l) END
    FROM body_packed p JOIN body_lines n ON n.slug = p.slug AND n.i = p.i + 1),
noted AS (
    SELECT slug, doc_id, published, chunk_index, 'Main & first' AS heading, title || ' — Main & first' || chr(10) || chr(10) || piece AS text
    FROM (SELECT slug, chunk_index, string_agg(l, chr(10) ORDER BY i) AS piece FROM body_packed GROUP BY slug, chunk_index) JOIN notes USING (slug))"""


def _sql(body: str, *parts: str) -> str:
    return _WITH.replace("{fused}", ", ".join([*parts, "one AS (SELECT 1)"])) + "\n" + body


_TAG = r"regexp_replace(lower(trim(regexp_replace({0}, '" + SPACE + r"+', ' ', 'g'))), ' ', '-', 'g')"
_RAW_TAGS = "[' ' || lang || '  ' || source || ' ', upper(lang), '', lang, upper(lang) || chr(9) || upper(source), 'Trade-Offs']"

ORACLE_SQL: dict[str, str] = {
    "parse_notes": _sql("""
        SELECT CASE doc_id % 5 WHEN 0 THEN '_drafts/.h/' || slug WHEN 1 THEN '.' || category || '/_' || doc_id ELSE slug END AS slug, '/notes/' || (CASE doc_id % 5 WHEN 0 THEN '_drafts/.h/' || slug WHEN 1 THEN '.' || category || '/_' || doc_id ELSE slug END) || '.html' AS url,
               title, CASE WHEN doc_id % 3 = 0 THEN 'Other: heading' ELSE title END AS heading, title AS list_title, NULL::VARCHAR AS description, lang, 'Notes' AS category, date, '' AS date_text,
               md5(regexp_replace(body, '^""" + SPACE + "+|" + SPACE + r"""+\z', '', 'g')) AS content_md5, published, array_to_string(list_transform(tags, lambda x: lower(x)) || ['odd-tag'], ',') AS tags FROM notes"""),
    "front_matter": _sql("SELECT slug, CASE WHEN published THEN 3 ELSE 4 END AS n_entries, title, title AS heading, lang, 'Notes' AS category, '' AS date, published FROM notes"),
    "merge_small_sections": _sql("""
        SELECT doc_id, pos, 'H' || min(i) AS heading, string_agg(CASE WHEN opens THEN l ELSE 'H' || i || chr(10) || l END, chr(10) ORDER BY i) AS text FROM (
            SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (SELECT *, i = 1 OR length(l) >= 200 AS opens FROM lines)) GROUP BY doc_id, pos"""),
    "compose_chunks": _sql("SELECT slug, chunk_index, heading, md5(heading || ' — ' || heading || chr(10) || chr(10) || text) AS text_md5 FROM chunks"),
    "lexical_document": _sql("SELECT slug, chunk_index, md5(title || ' ' || heading || ' ' || text) AS document_md5 FROM shown"),
    "format_excerpts": _sql(f"""
        SELECT slug, chunk_index, md5(title || ' ({_SITE}' || url || ') — ' || heading || ':' || chr(10) || text) AS excerpt_md5,
               md5(title || ' ({_SITE}' || url || ') — ' || heading || ' (shares tags: a, ' || slug || '):' || chr(10) || text) AS related_md5 FROM shown"""),
    "visible_notes": _sql("SELECT slug, date, category FROM visible"),
    "bm25_scores": _sql("SELECT query_id, slug, chunk_index, round(score, 6) AS score FROM scored"),
    "chunks_in_slugs": _sql("SELECT query_id, slug, chunk_index FROM (SELECT DISTINCT query_id, slug FROM lexical WHERE rank <= 6) JOIN chunks USING (slug)"),
    "embed_once": "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE 64 END AS dim, true AS same FROM documents",
    "check_embedding_dim": "SELECT count(*) AS n_same, 0::BIGINT AS n_other FROM embeddings WHERE len(embedding) = 64",
    "sync_notes": _sql("""
        SELECT slug, title, CASE WHEN doc_id IN (SELECT doc_id FROM known) THEN '2024-01-01' ELSE '2024-03-01' END AS created, '2024-03-01' AS updated FROM notes WHERE lang <> 'es'""", _CHANGES),
    "normalize_tags": f"""
        SELECT doc_id, string_agg(tag, ',' ORDER BY pos) AS tags FROM (
            SELECT doc_id, tag, min(pos) AS pos FROM (SELECT doc_id, {_TAG.replace("{0}", "raw")} AS tag, pos FROM (SELECT doc_id, unnest({_RAW_TAGS}) AS raw, generate_subscripts({_RAW_TAGS}, 1) AS pos FROM documents))
            WHERE tag <> '' GROUP BY doc_id, tag) GROUP BY doc_id""",
    "codec_round_trip": _sql("""
        SELECT slug, '["' || array_to_string(tags, '","') || '"]' AS tags_json, CASE WHEN published THEN len(tags) ELSE 0 END AS n_tags, true AS same_vector, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE coalesce(len(embedding), -1) END AS n_numbers FROM notes LEFT JOIN embeddings ON vec_id = doc_id"""),
    "jdbc_rows": _sql("""SELECT slug, '["' || array_to_string(tags, '","') || '"]' AS tags, published::INT AS published, true AS same FROM notes"""),
    "canonical_slug": _sql(f"SELECT doc_id, slug || CASE WHEN doc_id % 3 = 1 THEN '.html' ELSE '' END AS slug, url, '{_SITE}' || url AS source_url FROM notes"),
    "normalize_text": _sql("SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i), '') AS text FROM documents LEFT JOIN lines USING (doc_id) GROUP BY doc_id"),
    "split_long_text": _sql("SELECT slug, chunk_index, text FROM chunks"),
    "chunk_hash": _sql(f"SELECT slug, chunk_index, sha256('{MODEL}' || chr(0) || text) AS content_hash FROM chunks"),
    "lexical_tokens": f"SELECT doc_id, len(ts) AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tokens('text')} AS ts FROM documents)",
    "list_published_notes": _sql("SELECT slug, url, title, category, date, lang, array_to_string(tags, ',') AS tags FROM visible"),
    "get_published_notes": _sql("SELECT slug, title, date FROM visible WHERE list_contains(tags, 'toxic')"),
    "embeddable_notes": _sql("SELECT slug, date FROM notes WHERE published"),
    "published_tags": _sql("SELECT slug, array_to_string(tags, ',') AS tags FROM visible"),
    "visible_chunks": _sql("SELECT slug, chunk_index, title, url, length(text) AS chars FROM shown"),
    "validate_conversations": """
        SELECT conv_id, reason IS NULL AS is_valid, reason FROM (
            SELECT conv_id, CASE WHEN count(*) > 20 THEN 'too many messages' WHEN NOT bool_and(coalesce(role IN ('user', 'assistant'), false)) THEN 'unknown role'
                WHEN NOT bool_and(length(coalesce(text, '')) BETWEEN 1 AND 4000) THEN 'empty or too long message' WHEN arg_max(role, turn) <> 'user' THEN 'last message is not from the user' END AS reason
            FROM conversations GROUP BY conv_id)""",
    "query_from_conversation": "SELECT conv_id, arg_max(text, turn) AS query FROM conversations GROUP BY conv_id",
    "history_window": """
        SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3""",
    "changed_chunks": _sql("SELECT slug, chunk_index, is_changed FROM changes", _CHANGES),
    "sync_counts": _sql("SELECT count(*) FILTER (is_changed) AS embedded, count(*) FILTER (NOT is_changed) AS unchanged FROM changes", _CHANGES),
    "upsert_notes": _sql("""
        SELECT n.slug, CASE WHEN i THEN n.title ELSE 'Old ' || n.title END AS title, n.date, CASE WHEN s THEN '2024-01-01' ELSE '2024-03-01' END AS created, CASE WHEN i THEN '2024-03-01' ELSE '2024-01-01' END AS updated
        FROM (SELECT *, lang <> 'es' AS i, doc_id IN (SELECT doc_id FROM known) AS s FROM notes) n WHERE i OR s""", _CHANGES),
    "upsert_chunks": _sql("""
        SELECT slug, chunk_index, CASE WHEN n.slug IS NOT NULL THEN n.content_hash ELSE s.content_hash END AS content_hash, CASE WHEN n.slug IS NOT NULL THEN '2024-03-01' ELSE '2024-01-01' END AS updated
        FROM stored s FULL JOIN (SELECT * FROM changes WHERE is_changed) n USING (slug, chunk_index)""".replace("SELECT slug, chunk_index, CASE", "SELECT coalesce(s.slug, n.slug) AS slug, coalesce(s.chunk_index, n.chunk_index) AS chunk_index, CASE").replace("USING (slug, chunk_index)", "ON s.slug = n.slug AND s.chunk_index = n.chunk_index"), _CHANGES),
    "delete_stale_notes": _sql("SELECT slug, title FROM notes WHERE lang <> 'es'"),
    "delete_stale_chunk_slugs": _sql("SELECT slug, chunk_index FROM stored WHERE slug IN (SELECT slug FROM notes WHERE published)", _CHANGES),
    "delete_chunk_tail": _sql("""
        SELECT s.* FROM stored s LEFT JOIN (SELECT slug, count(*) AS n FROM fresh GROUP BY slug) f USING (slug) WHERE n IS NULL OR chunk_index < n""", _CHANGES),
    "html_sections": f"""
        WITH plain AS (
            SELECT page_id, regexp_replace(regexp_replace(replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>'), '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<![^>]*>', '', 'g'),
                   '</?(p|li|ul|ol|pre|blockquote|figure|figcaption|table|tr)(\\s[^>]*)?>', chr(10), 'g') AS h FROM pages),
        parts AS (
            SELECT page_id, 0 AS pos, NULL AS heading, split_part(h, '<h2>', 1) AS body FROM plain
            UNION ALL SELECT page_id, 1, split_part(split_part(h, '<h2>', 2), '</h2>', 1), split_part(h, '</h2>', 2) FROM plain WHERE contains(h, '<h2>')),
        decoded AS (
            SELECT page_id, pos, list_transform([heading, body], lambda x: replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&')) AS x FROM parts),
        lines AS (SELECT page_id, pos, i, trim(regexp_replace(l, '{SPACE}+', ' ', 'g')) AS l FROM (SELECT page_id, pos, unnest(string_split(x[2], chr(10))) AS l, generate_subscripts(string_split(x[2], chr(10)), 1) AS i FROM decoded)),
        texts AS (SELECT page_id, pos, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (l <> ''), '') AS text FROM lines GROUP BY page_id, pos),
        found AS (SELECT page_id, pos, regexp_replace(x[1], '^{SPACE}+|{SPACE}+\\z', '', 'g') AS heading, text FROM decoded JOIN texts USING (page_id, pos))
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, nullif(heading, '') AS heading, text FROM found WHERE text <> '' OR coalesce(heading, '') <> ''""",
    "chunk_notes": _sql("SELECT slug, chunk_index, heading, text FROM noted", _NOTED),
    "sync_changed_notes": _sql(
        f"""SELECT slug, chunk_index, sha256('{MODEL}' || chr(0) || text) AS content_hash, 32 AS dim, CASE WHEN edited IS NULL OR edited THEN '2024-03-01' ELSE '2024-01-01' END AS updated
        FROM noted LEFT JOIN known USING (doc_id) WHERE published""", _CHANGES, _NOTED),
    "sync_chunks": _sql(f"""
        SELECT slug, chunk_index, sha256('{MODEL}' || chr(0) || text) AS content_hash, 32 AS dim, CASE WHEN edited THEN '2024-03-01' WHEN edited IS NULL THEN '2024-03-01' ELSE '2024-01-01' END AS updated
        FROM noted LEFT JOIN known USING (doc_id) WHERE published""", _NOTED, _CHANGES),
    "lexical_index": _sql("SELECT term, slug, chunk_index, tf, doc_len FROM postings"),
    "corpus_stats": _sql("SELECT n_chunks, round(avg_len, 9) AS avg_len FROM stats"),
    "moved_totals": _sql("SELECT term, count(*) AS df, sum(tf)::BIGINT AS size FROM postings GROUP BY term UNION ALL SELECT '', count(*), sum(len(ts))::BIGINT FROM tokens HAVING count(*) > 0"),
    "document_frequencies": _sql("SELECT term, df FROM freq"),
    "rank_lexical": _sql("SELECT query_id, rank, slug, chunk_index, round(score, 6) AS score FROM lexical"),
    "semantic_top_k": """
        SELECT query_id, rank, slug, chunk_index, round(distance, 6) AS distance FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, slug, chunk_index) AS rank FROM (
                SELECT q.vec_id AS query_id, 'v' || e.vec_id AS slug, 0 AS chunk_index, round(list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS distance
                FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 24""",
    "reciprocal_rank_fusion": _sql("SELECT query_id, rank, slug, chunk_index, round(score, 9) AS score, round(distance, 6) AS distance FROM fused", _FUSED.format(name="fused", semantic="semantic")),
    "hybrid_search": _sql("SELECT query_id, rank, slug, chunk_index, title, url, round(score, 9) AS score, round(distance, 6) AS distance, length(text) AS chars FROM hits JOIN shown USING (slug, chunk_index)", _HITS),
    "tag_neighbors": _sql("SELECT query_id, slug, shared_tags FROM best_near", "best AS (SELECT * FROM lexical WHERE rank <= 6)", _TAGS.format(name="best", hits="best")),
    "expand_neighbors": _sql("SELECT query_id, rank, slug, chunk_index, round(distance, 6) AS distance, shared_tags FROM widened", _HITS, _HIT_TAGS, _RELATED.format(site=_SITE)),
    "distinct_sources": _sql("SELECT query_id, sources_json FROM sources", _HITS, _HIT_TAGS, _RELATED.format(site=_SITE)),
    "build_prompts": _sql(f"""
        SELECT h.conv_id, coalesce(sources_json, '{{"sources":[]}}') AS sources_json, n + 1 AS n_messages,
               md5('{_D.system.replace("'", "''")}' || coalesce(chr(10) || chr(10) || '{_D.excerpts_intro}' || chr(10) || chr(10) || found, '') || coalesce(chr(10) || chr(10) || '{_D.related_intro}' || chr(10) || chr(10) || wide, '')) AS system_md5, history_md5
        FROM (SELECT conv_id, count(*) AS n, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS history_md5 FROM recent GROUP BY conv_id) h
        LEFT JOIN sources s ON s.query_id = h.conv_id
        LEFT JOIN (SELECT query_id, string_agg(title || ' ({_SITE}' || url || ') — ' || heading || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS found FROM hits JOIN shown USING (slug, chunk_index) GROUP BY query_id) f ON f.query_id = h.conv_id
        LEFT JOIN (SELECT query_id, string_agg(title || ' ({_SITE}' || url || ') — ' || heading || ' (shares tags: ' || shown_as || '):' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS wide FROM widened JOIN shown USING (slug, chunk_index) GROUP BY query_id) w ON w.query_id = h.conv_id""",
        _HITS, _HIT_TAGS, _RELATED.format(site=_SITE), """
        good AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) <= 20 AND bool_and(coalesce(role IN ('user', 'assistant'), false)) AND bool_and(length(coalesce(text, '')) BETWEEN 1 AND 4000) AND arg_max(role, turn) = 'user'),
        recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations SEMI JOIN good USING (conv_id)) WHERE back <= 8)"""),
}

ORACLE_SQL["upsert_bucketed_chunks"] = ORACLE_SQL["upsert_chunks"]  # the same rows in another way
