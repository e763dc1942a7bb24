"""Quality classifier: a generalised additive model with pairwise interactions over text features.

Shallow trees, boosted feature by feature in cycles, add up to one lookup table per feature and per chosen pair of
features; a score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_jobs.llm.common import learns, materialise, small, unused

FEATURES = (
    "chars", "upper", "digits", "symbols", "pauses", "bars", "shouts", "non_ascii", "word_length", "longest_word",
    "distinct_words", "words_a_line", "distinct_lines", "full_stops", "capital_words", "odd_words",
)
_LOWER, _UPPER, _DIGIT, _SPACE, _PAUSE, _STOP, _BAR, _SHOUT, _HIGH, _SYMBOL = range(10)


def _classes() -> np.ndarray:
    of = np.full(256, _SYMBOL, dtype=np.uint8)
    for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b" \t\n\r\x0b\x0c", _SPACE), (b",;:'\"()-", _PAUSE), (b".?", _STOP), (b"|", _BAR), (b"!", _SHOUT)):
        of[list(chars)] = kind
    of[128:] = _HIGH
    return of


def features(text: str, classes: np.ndarray) -> list[float]:
    """The features of a whole text, in the order of FEATURES; all 0 for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = np.bincount(classes[np.frombuffer(raw, dtype=np.uint8)], minlength=10)
    seen = max(1, len(raw) - int(n[_SPACE]))
    lines = [x for x in raw.split(b"\n") if x]
    share = n / seen
    longest = max(map(len, words))
    capital = sum(1 for w in words if w[:1].isupper())
    odd = sum(1 for w in words if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1] in b".,;:?"))
    return [
        float(np.log1p(len(text))), share[_UPPER], share[_DIGIT], share[_SYMBOL], share[_PAUSE], share[_BAR], share[_SHOUT], share[_HIGH],
        seen / len(words), float(np.log1p(longest)), len(set(words)) / len(words), float(np.log1p(len(words) / max(1, len(lines)))),
        len(set(lines)) / max(1, len(lines)), n[_STOP] / len(words), capital / len(words), odd / len(words),
    ]


def with_features(docs: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """``docs`` with the text replaced by its features (null text: as empty); a column named ``out`` is replaced, all others stay.

    Repeated rows stay repeated, an empty table empty; whole texts of any length are read.
    """
    others = [c for c in docs.columns if c not in (text, out)]
    rows = docs.withColumn(unused(docs, "_text"), F.coalesce(F.col(text), F.lit(""))).drop(text, out)
    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField(out, T.ArrayType(T.FloatType()))])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for batch in small(batches):
            k = batch.num_columns - 1
            values = [features(x, classes) for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(values, pa.list_(pa.float32()))], names=[*others, out])

    return rows.mapInArrow(measured, schema)


@dataclass
class AdditiveModel:
    """Log odds = prior + one table entry per feature + one per pair; ``edges`` cut features into bins."""

    prior: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        total = np.full(len(x), self.prior)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for a, b, table in self.pairs:
                total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best gain of one cut through a histogram, and the bin it comes before."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of two levels over one feature's bins, as a table."""
    _, mid = _cut(g, h, ridge)
    out = np.zeros(len(g))
    for a, b in ((0, mid), (mid, len(g))):
        if a < b:
            gain, at = _cut(g[a:b], h[a:b], ridge)
            for c, d in ((a, a + at), (a + at, b)) if gain > 0 else ((a, b),):
                out[c:d] = _leaf(g[c:d].sum(), h[c:d].sum(), ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """One cut of each axis: gain over no cut, and the four leaves as a table."""
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    (n, m), best = g.shape, (0.0, 0, 0)
    if n < 2 or m < 2:
        return 0.0, np.zeros_like(g)
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    total = 0.0
    for c in (lambda t: t[i, j], lambda t: t[i, m] - t[i, j], lambda t: t[n, j] - t[i, j], lambda t: t[n, m] - t[i, m] - t[n, j] + t[i, j]):
        total = total + c(cg) ** 2 / (c(ch) + ridge)
    gain = total - cg[n, m] ** 2 / (ch[n, m] + ridge)
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best = (float(gain[at]), int(at[0]) + 1, int(at[1]) + 1)
    out = np.zeros_like(g)
    for rows in (slice(0, best[1]), slice(best[1], n)):
        for cols in (slice(0, best[2]), slice(best[2], m)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum(), ridge)
    return best[0], out


def fit_model(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15, bins: int = 48, pair_bins: int = 12, pairs: int = 6, ridge: float = 5.0) -> AdditiveModel:
    """Fit to rows of features and 0/1 labels; with one label only (or no row) the prior is all there is."""
    n, positive = len(y), float(np.sum(y))
    prior = float(np.log((positive + 1) / (n - positive + 1)))
    model = AdditiveModel(prior)
    if positive in (0.0, float(n)):
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    odds = np.full(n, prior)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, of in enumerate(binned):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(of, g, size), np.bincount(of, h, size), ridge)
            model.tables[j] += step
            odds += step[of]
    model.pair_edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, pair_bins + 1)[1:-1])) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def pair_hist(a: int, b: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], w, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    gains = sorted(((_pair_tree(pair_hist(a, b, g), pair_hist(a, b, h), ridge)[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for gain, a, b in gains[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            g, h = slopes()
            step = rate * _pair_tree(pair_hist(a, b, g), pair_hist(a, b, h), ridge)[1]
            table += step
            odds += step[coarse[a], coarse[b]]
    return model


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", max_rows: int = 40_000) -> AdditiveModel:
    """Fit to labelled rows of ``measured`` (id, features), the held-out fifth left out.

    At most about ``max_rows`` different rows are fitted, chosen by a hash, so the driver's share is bounded whatever
    the size of the tables and of a group of repeated rows: equal rows count once, and an id of several texts or labels
    teaches each of them. Rows with a null id or label are not learned from. Other columns are not read.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_y")).where(F.col("_y").isNotNull() & learns("_id")).distinct()
    rows = materialise(measured.select(F.col(id_col).alias("_id"), "features").join(known, "_id").select("_id", "_y", "features").distinct(), "labelled")
    share = max_rows / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("_id", "features"), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = rows.toPandas().sort_values(["_id", "_y"], kind="stable")
    x = np.array(got["features"].tolist(), dtype=np.float32).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["_y"].to_numpy(), got["_id"].to_numpy()))
    return fit_model(x[order], (got["_y"].to_numpy()[order] > 0).astype(float))


def score(measured: DataFrame, model: AdditiveModel, out: str = "score") -> DataFrame:
    """``measured`` with ``features`` replaced by the score (double, 0 to 1); a column named ``out`` is replaced, all others stay.

    A score depends on the row's features only: repeated rows get equal ones, and an empty table stays empty.
    """
    others = [c for c in measured.columns if c not in ("features", out)]
    rows = measured.withColumn(unused(measured, "_features"), F.col("features")).drop("features", out)
    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField(out, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 1
            x = batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(model.score(x))], names=[*others, out])

    return rows.mapInArrow(scored, schema)


def score_texts(docs: DataFrame, model: AdditiveModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the text's score (null text: as empty) as a further column, in one pass; a column named ``out`` is replaced.

    Whole texts of any length are measured, some at a time. A score depends on the text only, so repeated rows and equal
    texts get equal ones; an empty table stays empty. All other columns stay, whatever their names.
    """
    names = [c for c in docs.columns if c != out]
    rows = docs.drop(out)
    at = names.index(text)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for batch in small(batches):
            x = np.array([features(t or "", classes) for t in batch.column(at).to_pylist()], dtype=np.float32).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*names, out])

    return rows.mapInArrow(scored, schema)
