"""SimHash near-duplicates: vantage-point trees over Hamming distance find every pair of close fingerprints.

Fingerprints are cut into bands. Of two fingerprints at most R bits apart, some band i is at most r_i apart, when the
r_i + 1 add up to R + 1; so there is one tree per band, over the band's distance and with its own radius. A node sends
a fingerprint to the inner branch if its distance to the vantage point is at most mu + r, and to the outer branch if it
is more than mu: by the triangle inequality two fingerprints within r share a branch at every node, and so a leaf.
Leaves are shards, which overlap along the boundaries and are searched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_jobs.llm.common import drop_located, join_counted, materialise, rereadable, small, unused, with_locator
from corpus_jobs.llm.components import components

#: Bands of the 64 bits and their radii, for links of 4 or fewer differing bits: (1 + 1) + (1 + 1) + (0 + 1) = 4 + 1.
BANDS = ((0, 21, 1), (21, 42, 1), (42, 64, 0))


def fingerprint(text: str, words: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    raw = text.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    parts = raw.split()  # of bytes: \x20 and \x09-\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    n = len(parts) - k + 1
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the text replaced by its fingerprint, as a signed 64-bit number (null or empty text: 0).

    A column named ``out`` is replaced, every other one stays; repeated rows stay repeated, an empty table empty. Texts
    are read whole; what a worker holds beside one is some 200 bytes for each of its words.
    """
    others = [c for c in docs.columns if c not in (text, out)]
    rows = docs.withColumn(unused(docs, "_text"), F.coalesce(F.col(text), F.lit(""))).drop(text, out)
    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField(out, T.LongType())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            k = batch.num_columns - 1
            found = np.array([fingerprint(x) for x in batch.column(k).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(found)], names=[*others, out])

    return rows.mapInArrow(marked, schema)


@dataclass
class Forest:
    """Nodes of all trees; a child below 0 is leaf ``-1 - child``, and ``bands`` has each leaf's band."""

    vantage: np.ndarray
    mask: np.ndarray
    mu: np.ndarray
    radius: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    roots: np.ndarray
    bands: list[int]

    @property
    def leaves(self) -> int:
        return len(self.bands)

    def shards(self, x: np.ndarray, trees: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a fingerprint belongs to, in all trees or in one of ``trees`` each."""
        rows = np.tile(np.arange(len(x)), len(self.roots)) if trees is None else np.arange(len(x))
        nodes = np.repeat(self.roots, len(x)) if trees is None else self.roots[trees]
        found_rows, found_leaves = [], []
        while len(rows):
            done = nodes < 0
            found_rows.append(rows[done])
            found_leaves.append(-1 - nodes[done])
            rows, nodes = rows[~done], nodes[~done]
            d = np.bitwise_count((x[rows] ^ self.vantage[nodes]) & self.mask[nodes]).astype(np.int64)
            near, far = d <= self.mu[nodes] + self.radius[nodes], d > self.mu[nodes]
            rows, nodes = np.concatenate((rows[near], rows[far])), np.concatenate((self.inner[nodes[near]], self.outer[nodes[far]]))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_rows]), np.concatenate([none, *found_leaves])


def grow_trees(plots: list[tuple[np.ndarray, int, int]], leaf: int = 2048, depth: int = 24, bands=BANDS, tries: int = 8) -> Forest:
    """A tree for every plot: a sample, of how many fingerprints it is one, and the number of the band.

    A branch ends at about ``leaf`` fingerprints, or where no vantage point parts it.
    """
    rng = np.random.default_rng(7)
    nodes: list[list] = []
    roots, of_leaf = [], []
    for sample, total, band in plots:
        low, high, radius = bands[band]
        mask, least = np.uint64((1 << high) - (1 << low)), max(8, leaf * len(sample) / max(1, total))
        todo = [(sample, 0, None, 0)]  # fingerprints, depth, parent and side
        while todo:
            part, level, parent, side = todo.pop()
            best = None
            if len(part) > least and level < depth:
                for vantage in rng.choice(part, tries):
                    d = np.bitwise_count((part ^ vantage) & mask).astype(np.int64)
                    for mu in {int(np.median(d)), int(np.median(d)) - 1}:
                        near, far = d <= mu + radius, d > mu
                        cost = int(near.sum()) ** 2 + int(far.sum()) ** 2
                        if best is None or cost < best[0]:
                            best = (cost, vantage, mu, near, far)
            if best is None or best[0] > 0.9 * len(part) ** 2:
                at = -1 - len(of_leaf)
                of_leaf.append(band)
            else:
                at = len(nodes)
                nodes.append([best[1], mask, best[2], radius, 0, 0])
                todo += [(part[best[3]], level + 1, at, 4), (part[best[4]], level + 1, at, 5)]
            if parent is None:
                roots.append(at)
            else:
                nodes[parent][side] = at
    columns = list(zip(*nodes, strict=True)) or [()] * 6
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)
    return Forest(*(np.array(c, kind) for c, kind in zip(columns, kinds, strict=True)), np.array(roots, np.int64), of_leaf)


def grow(sample: np.ndarray, total: int, leaf: int = 2048, depth: int = 24, bands=BANDS, tries: int = 8) -> Forest:
    """A tree for each band, from a sample of ``total`` fingerprints."""
    return grow_trees([(sample, total, k) for k in range(len(bands))], leaf, depth, bands, tries)


def close_components(x: np.ndarray, most: int) -> np.ndarray:
    """For each of the fingerprints, the index of the first that it reaches by steps of ``most`` bits or fewer."""
    parent = np.arange(len(x))
    block = max(1, min(1024, (1 << 22) // max(1, len(x))))
    for at in range(0, len(x), block):
        i, j = np.nonzero(np.bitwise_count(x[at : at + block, None] ^ x[None, at:]) <= most)
        i, j = i + at, j + at
        i, j = i[i < j], j[i < j]
        while len(i):
            a, b = parent[i], parent[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent


def _picked(rows: DataFrame, share: float) -> pd.DataFrame:
    return rows.where(F.pmod(F.xxhash64(F.lit("tree"), "fp"), F.lit(1 << 24)) < int(share * (1 << 24))).toPandas().sort_values("fp")


def _split_overfull(shards: DataFrame, bands: list[int], sample: int, leaf: int, shapes) -> DataFrame:
    """``shards`` (leaf, fp) with leaves of more than 4 * ``leaf`` fingerprints split by trees over their own members.

    Trees are grown from a sample of these leaves' members, no more than about ``sample``, and only such leaves' rows
    are written again, until no leaf is overfull that a vantage point parts. The driver gets a row for each of them.
    """
    spark, bands, whole = shards.sparkSession, list(bands), set()
    while True:
        sizes = shards.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 4 * leaf)
        over = {r["leaf"]: r["n"] for r in sizes.collect() if r["leaf"] not in whole}
        if not over:
            return shards
        names = list(over)
        numbered = F.broadcast(spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "leaf long, tree long"))
        members = shards.join(numbered, "leaf").select("tree", "fp")
        picked = _picked(members, min(1.0, sample / sum(over.values())))
        of = dict(iter(picked.groupby("tree")["fp"]))
        plots = [(of[k].to_numpy(np.int64).view(np.uint64) if k in of else np.zeros(0, np.uint64), over[name], bands[name]) for k, name in enumerate(names)]
        forest = grow_trees(plots, leaf, bands=shapes)
        whole.update(name for name, root in zip(names, forest.roots, strict=True) if root < 0)
        parted = [k for k, root in enumerate(forest.roots) if root >= 0]
        if not parted:
            return shards
        first = len(bands)
        bands += forest.bands

        def placed(batches: Iterator[pa.RecordBatch], forest=forest, first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(1).to_numpy()
                rows, leaves = forest.shards(x.view(np.uint64), batch.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(leaves + first), pa.array(x[rows])], names=["leaf", "fp"])

        parted_leaves = F.broadcast(spark.createDataFrame([(names[k], k) for k in parted], "leaf long, tree long"))
        again = shards.join(parted_leaves, "leaf").select("tree", "fp").mapInArrow(placed, "leaf long, fp long")
        shards = materialise(shards.join(parted_leaves, "leaf", "left_anti").unionByName(again), "shards")


def links(prints: DataFrame, most: int = 4, sample: int = 131_072, leaf: int = 2048, part: int = 8192, bands=BANDS) -> DataFrame:
    """Edges (a, b) that connect whatever fingerprints of the column ``fp`` (distinct) are linked by ``most`` bits or fewer.

    Each shard gives a spanning forest of its links, not all pairs. The trees are grown from a sample: an eighth of the
    fingerprints, but no more than about ``sample``, or one in 64 where that is more, up to 8 times ``sample``. Every
    fingerprint is searched. Leaves that turn out overfull are split again by trees of their own; one of more than
    ``part`` that no vantage point parts is searched in blocks: every pair of its blocks is a task. Leaves and the table
    of their sizes are no more than the samples allow, whatever the number of fingerprints.
    """
    if sum(r + 1 for _, _, r in bands) <= most:
        raise ValueError("the bands' radii don't cover links of that many bits")
    total = prints.count()
    picked = _picked(prints.select("fp"), min(0.125, max(sample, min(total / 64, 8 * sample)) / max(1, total)))
    forest = grow(picked["fp"].to_numpy(np.int64).view(np.uint64), total, leaf, bands=bands)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            rows, leaves = forest.shards(x.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(x[rows])], names=["leaf", "fp"])

    shards = materialise(prints.select("fp").mapInArrow(placed, "leaf long, fp long"), "shards")
    shards = _split_overfull(shards, forest.bands, 8 * sample, leaf, bands)
    sizes = shards.groupBy("leaf").agg(F.ceil(F.count("*") / part).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    tasks = shards.join(F.broadcast(sizes), "leaf").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("leaf", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")

    def searched(group: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(group["fp"].to_numpy(np.int64))
        root = close_components(x.view(np.uint64), most)
        away = root != np.arange(len(x))
        return pd.DataFrame({"a": x[away], "b": x[root[away]]})

    return tasks.groupBy("leaf", "p", "q").applyInPandas(searched, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest id reachable), root, size, and the columns ``extra``.

    Texts without words have fingerprint 0 and are linked like any other; a null id never is a smallest one, so a
    group of null ids only has a null component. Copies of a fingerprint are searched once; repeated rows count in
    ``size``, the number of rows of the component. Other columns are not read; an empty table gives no rows. Neither a
    fingerprint nor a component of many rows is shuffled by its key (see join_counted).
    """
    marks = materialise(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra)), "fingerprints")
    classes = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    roots = components(links(classes.select("fp"), most)).withColumnRenamed("node", "fp")
    rooted = materialise(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    sums = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("size"), F.count("*").alias("prints")), "components")
    found = materialise(join_counted(rooted, sums, "root", "prints").select("fp", "copies", "component_id", "root", "size"), "found")
    return join_counted(marks, found, "fp", "copies").select("doc_id", "fp", "component_id", "root", "size", *extra)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-copies, all columns as they were.

    Of each component (see near_groups) the row with the smallest id (null last) stays, of several such rows the first
    in the files.
    """
    docs = rereadable(docs)
    found = near_groups(with_locator(docs.select(F.col(id_col), F.col(text_col))), id_col, text_col, extra=("_locator",))
    several = materialise(found.where("size > 1").select("doc_id", "root", "_locator"), "several")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_locator")).alias("first")
    stay = several.groupBy("root").agg(first).select(F.col("first._locator").alias("_locator"))
    return drop_located(docs, materialise(several.select("_locator").join(stay, "_locator", "left_anti"), "gone"))
