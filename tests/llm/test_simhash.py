import random

import numpy as np
import xxhash

from corpus_jobs.llm import simhash
from corpus_jobs.llm.components import components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def clustered(rng, centres, around):
    out = [0]
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(around):
            out.append(x)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
    return list(dict.fromkeys(out))


def test_fingerprints():
    for text in ["", "  \n", "One", "a b c d", "A  b\tC d E f", "é É ß ſ x y z w v", "w " * 5000, "x" * 200_000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_trees_bring_every_close_pair_together():
    rng = random.Random(4)
    x = np.array(clustered(rng, 60, 12) + [rng.getrandbits(64) for _ in range(1500)], dtype=np.uint64)
    forest = simhash.grow(np.sort(x)[::2], len(x), leaf=40)
    rows, leaves = forest.shards(x)
    of = [set() for _ in x]
    for r, leaf in zip(rows.tolist(), leaves.tolist(), strict=True):
        of[r].add(leaf)
    assert forest.leaves > 30 and len(rows) < len(x) * forest.leaves / 3
    close = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 4, 1))
    assert len(close) > 100 and all(of[i] & of[j] for i, j in close)


def test_overfull_leaves_are_split_by_trees_of_their_own(spark):
    rng = random.Random(12)
    x = np.array(clustered(rng, 40, 8) + [rng.getrandbits(64) for _ in range(1200)], dtype=np.uint64)
    coarse = simhash.grow(np.sort(x)[::40], len(x), leaf=20)
    rows, leaves = coarse.shards(x)
    shards = spark.createDataFrame(list(zip(leaves.tolist(), x.view(np.int64)[rows].tolist(), strict=True)), "leaf long, fp long")
    sizes = [r["count"] for r in shards.groupBy("leaf").count().collect()]
    fine = simhash._split_overfull(shards, coarse.bands, 5000, 20, simhash.BANDS)
    assert max(sizes) > 200 and max(r["count"] for r in fine.groupBy("leaf").count().collect()) < max(sizes) / 2
    of = {}
    for r in fine.collect():
        of.setdefault(r["fp"], set()).add(r["leaf"])
    close = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 4, 1))
    signed = x.view(np.int64).tolist()
    assert len(of) == len(x) and len(close) > 50 and all(of[signed[i]] & of[signed[j]] for i, j in close)


def test_links_against_brute_force(spark):
    rng = random.Random(9)
    prints = clustered(rng, 80, 8) + [rng.getrandbits(64) for _ in range(300)]
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute(prints)
    for options in ({"leaf": 30}, {"leaf": 200, "part": 25}, {"leaf": 20, "sample": 40}):
        found = dict(components(simhash.links(df, **options)).toPandas().itertuples(index=False))
        roots = [found.get(x, x) for x in signed]
        assert len(set(roots)) == len(set(want)) and all((roots[i] == roots[w]) for i, w in enumerate(want))


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    data = [(5, base), (3, base + " more"), (9, base.upper()), (1, "other text altogether here now"), (2, None), (4, ""), (4, ""), (None, base), (8, " \t")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in data], "doc_id long, text string, fp int, root string")
    got = simhash.near_groups(docs).collect()
    prints = [plain_fingerprint(t or "") for _, t in data]
    want = brute(prints)
    ids = {w: min(d for (d, _), v in zip(data, want, strict=True) if v == w and d is not None) for w in set(want)}
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == sorted(((d, p, ids[w]) for (d, _), p, w in zip(data, prints, want, strict=True)), key=str)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(ids.values()))


def test_chains_and_empty_tables(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7)], "a long, b long")
    assert {r["root"] for r in components(chain).collect()} == {0}
    assert components(chain.where("false")).count() == 0
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
