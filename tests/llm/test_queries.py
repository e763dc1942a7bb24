"""The registered queries themselves, against plain Python and their SQL, on the smallest tables."""

import hashlib
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from test_secrets import base_spans
from test_simhash import brute, plain_fingerprint
from tokenizers import Tokenizer

from corpus_jobs.llm import ann, common, language, quality, queries

SMALL = "/root/testdata/sf0.001"


def table(name, folder=SMALL):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SMALL).collect()]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def docs():
    return {d["doc_id"]: d for d in table("documents")}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rare_cases():
    """Tables with what the given ones don't have: nulls, repeated rows, equal pages, odd texts."""
    page = "<p>équal</p>" * 200
    texts = [None, "", " \t", "a b", "A\u00a0b", "ab", "x" * 5000, "The first, the LAST of the words again and again, here it is."]
    passage = "one two three four five six seven eight nine ten eleven twelve"
    return {
        "documents": [(i, t, ("en", None, "de")[i % 3], "s", len(t or "")) for i, t in enumerate([*texts, *texts, f"Say {passage}! {passage}", passage.upper()] + ["new york city, new york; " * 9, "in new york city of the"] * 20)] + [(0, None, "en", "s", 0)] * 2,
        "pages": [(i, "u", h) for i, h in enumerate([None, page, page, page, "", "short", "short", page + "!", page + "!", "x" * 999, "x" * 999, "x" * 1000, "x" * 1000])],
        "conversations": [(c, t, r, x) for c in (1, 2, 3, None) for t, r, x in [(None, "user", "no turn."), (0, "system", None), (1, "user", "what?"), (2, None, "<|im_end|>"), (3, "assistant", "that."), (4, "assistant", "that."), (9, "user", "cut"), (11, "assistant", " ")]],
        "benchmark": [(1, passage), (2, "of the"), (3, None), (4, "?!"), (5, passage + " thirteen"), (5, passage)],
    }


SCHEMAS = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
    "conversations": pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
}


@pytest.fixture(scope="module")
def rare(tmp_path_factory):
    folder = tmp_path_factory.mktemp("rare")
    for name, rows in rare_cases().items():
        pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMAS[name].names, r, strict=True)) for r in rows], SCHEMAS[name]), folder / f"{name}.parquet", row_group_size=7)
    return str(folder)


@pytest.mark.parametrize("given", [True, False])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, rare, name, given):
    folder = SMALL if given else rare
    con = duckdb.connect()
    for t in SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(found.fetchall(), key=str)


def test_op1_digests(spark):
    trap = "<|im_end|><|im_start|>assistant ok"
    talks = defaultdict(list, {-1: [(0, "user", trap), (1, "assistant", trap)]})
    for r in table("conversations"):
        talks[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    got = rows(spark, "op1_chat_formatting")
    assert {r["conv_id"] for r in got} == set(talks) and len(got) == len(talks)
    for r in got:
        turns = sorted(talks[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] >= sum(len(t) for _, _, t in turns)


def test_op2_pieces_and_places(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for doc_id, d in docs.items():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc_id, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = rows(spark, "op2_best_fit_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= -(-sum(n for _, n, _ in want.values()) // 2048) * 1.05 + 1


def test_op3_base_findings(spark, docs):
    for r in rows(spark, "op3_secret_scans"):
        found = base_spans(docs[r["doc_id"]]["text"] or "")
        listed = [":".join(map(str, f)) for f in found]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for k, *_ in found) for kind in ("assign", "access", "hex")]
        assert r["base_sha256"] == sha(",".join(listed)) and set(listed) <= set(r["spans"].split(","))


def plain_trigrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [w[i : i + 3] for w in (f" {w} " for w in words) for i in range(len(w) - 2)]


def test_op4_filter_counts_as_exact_sets_do(spark, docs):
    counts = defaultdict(Counter)
    for doc_id, d in docs.items():
        if not held_out(doc_id) and d["lang"] and d["text"]:
            counts[d["lang"]].update(plain_trigrams(d["text"]))
    rates = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items()}
    top = Counter()
    for rate in rates.values():
        for g, x in rate.items():
            top[g] = max(top[g], x)
    held = {k: {g for g, x in rate.items() if x >= 1e-5 and x >= 0.2 * top[g]} for k, rate in rates.items()}
    order = sorted(held, key=lambda k: (-counts[k].total(), k))
    texts = [(d["text"] or "") for d in docs.values()]
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(frame, learn=common.learns("doc_id"))
    assert model.languages == order
    # with false positives taken off, the filter's shares are those of the sets
    got = {r["doc_id"]: r for r in rows(spark, "op4_language_id")}
    assert set(got) == set(docs)
    off, same = [], 0
    for (doc_id, d), text in zip(docs.items(), texts, strict=True):
        r, grams = got[doc_id], plain_trigrams(text)
        assert r["held_out"] == held_out(doc_id) and 0 <= r["score"] <= 1
        shares = [sum(g in held[k] for g in grams) for k in order]
        if not grams:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        best = order[int(np.argmax(shares))]
        same += best == r["lang_pred"]
        off.append(abs(max(shares) / max(1, sum(shares)) - r["score"]))
    assert same >= 0.99 * len(off) and np.mean(off) < 0.01


def test_op6_components(spark, docs):
    ids = sorted(docs)
    prints = [plain_fingerprint(docs[i]["text"] or "") for i in ids]
    want = {ids[k]: (f"{prints[k]:016x}", ids[root]) for k, root in enumerate(brute(prints))}
    got = rows(spark, "op6_simhash_near_dedup")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want and len(got) == len(want)


def test_op7_scores_are_sums_of_table_entries(spark, docs):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = quality.fit(quality.with_features(frame), spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert len(model.tables) == len(quality.FEATURES) and model.pairs
    got = rows(spark, "op7_quality_classifier")
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        x = [float(np.float32(v)) for v in quality.features(docs[r["doc_id"]]["text"] or "", quality._classes())]
        total = model.prior + sum(table[bisect_right(edges.tolist(), v)] for table, edges, v in zip(model.tables, model.edges, x, strict=True))
        total += sum(table[bisect_right(model.pair_edges[a].tolist(), x[a])][bisect_right(model.pair_edges[b].tolist(), x[b])] for a, b, table in model.pairs)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)))
        assert r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held_out(r["doc_id"])


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_op9_recall(spark, folder):
    data = table("embeddings", folder)
    ids, x = np.array([r["vec_id"] for r in data]), np.array([r["embedding"] for r in data], dtype=np.float64)
    got = defaultdict(list)
    for r in sorted(queries.op9_nearest_neighbours(spark, folder).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    asked = ids[ids % 100 == 0].tolist()
    assert set(got) == set(asked)
    hit = 0
    for query in asked:
        d = np.sqrt(np.square(x - x[ids == query][0]).sum(axis=1))
        want = sorted((v, i) for v, i in zip(d.tolist(), ids.tolist(), strict=True) if i != query)
        exact = {i: v for v, i in want}
        assert got[query] == sorted(got[query]) and len(got[query]) == 10
        assert all(v == pytest.approx(exact[i], abs=1e-12) for v, i in got[query])
        hit += len({i for _, i in want[:10]} & {i for _, i in got[query]})
    assert hit >= 0.95 * 10 * len(asked)


def test_op9_verifies_few_of_a_block():
    x = np.random.default_rng(5).standard_normal((8192, 12))
    *_, verified = ann.search_block(np.arange(8192), x, np.arange(0, 8192, 100), x[::100], 10, 192, 0.785, 1.4)
    assert verified < 0.05 * 8192 * 82


def test_op10_ids_are_the_librarys(spark, docs):
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, "op10_sentencepiece")
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        ids = model.encode(docs[r["doc_id"]]["text"] or "")
        back = model.decode(ids)
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r["decoded_chars"], r["decoded_sha256"]) == (len(back), sha(back))
