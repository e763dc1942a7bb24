"""Searches inside tasks: sparse sums with bounds, dense blocks, and the k best rows of all that a task has seen."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Entries:
    """Weights of (query, term); queries and terms are numbered, and each block of queries is a dense matrix over its own terms."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, block: int = 256):
        order = np.argsort(query, kind="stable")
        self.query, self.term, self.weight, self.queries, self.block = query[order], term[order], weight[order], queries, block

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(queries, their terms in order, matrix of terms x queries)."""
        for at in range(0, self.queries, self.block):
            end = min(at + self.block, self.queries)
            own = slice(*np.searchsorted(self.query, (at, end)))
            terms, row = np.unique(self.term[own], return_inverse=True)
            matrix = np.zeros((len(terms), end - at))
            np.add.at(matrix, (row, self.query[own] - at), self.weight[own])
            yield slice(at, end), terms, matrix


def dense(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int, wanted: np.ndarray) -> np.ndarray:
    """Matrix of n rows x wanted terms out of (row, term, value) entries; other terms' entries are left out."""
    out = np.zeros((n, len(wanted)))
    if len(wanted) and len(terms):
        at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
        here = wanted[at] == terms
        out[rows[here], at[here]] = values[here]
    return out


def listed(lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) for every element of string lists that is in the vocabulary."""
    rows, terms = pc.list_parent_indices(lists), pc.index_in(pc.list_flatten(lists), value_set=vocabulary)
    known = pc.is_valid(terms)
    return pc.filter(rows, known).to_numpy(zero_copy_only=False).astype(np.int64), pc.filter(terms, known).to_numpy(zero_copy_only=False).astype(np.int64)


class Best:
    """The ``k`` rows with the smallest keys of every query, of all rows that a task has seen; ties by slug, then number."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.worst = np.full(queries, np.inf)  # of the k kept; a row with a greater key can't come in
        self.kept: dict[int, list[tuple[float, str, int]]] = {}

    def offer(self, query: np.ndarray, row: np.ndarray, key: np.ndarray, slugs: Sequence[str], numbers: np.ndarray, order: np.ndarray) -> None:
        """Pairs of a query and a row of a batch, with the rows' slugs, numbers and places in the order of both (see in_order)."""
        if self.k <= 0:
            return
        near = np.flatnonzero(key <= self.worst[query])
        near = near[np.lexsort((order[row[near]], key[near], query[near]))]
        query, row, key = query[near], row[near], key[near]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        for start, end in zip(starts.tolist(), np.append(starts, len(query))[1:].tolist(), strict=True):
            own = slice(start, min(end, start + self.k))
            new = [(x, slugs[r], n) for x, r, n in zip(key[own].tolist(), row[own].tolist(), numbers[row[own]].tolist(), strict=True)]
            q = int(query[start])
            kept = sorted([*self.kept.get(q, ()), *new])[: self.k]
            self.kept[q] = kept
            if len(kept) == self.k:
                self.worst[q] = kept[-1][0]

    def found(self) -> tuple[np.ndarray, list[str], list[int], np.ndarray]:
        """(query, slug, number, key) of all rows kept."""
        rows = [(q, *x) for q, kept in self.kept.items() for x in kept]
        query, key, slugs, numbers = zip(*rows, strict=True) if rows else ((), (), (), ())
        return np.array(query, np.int64), list(slugs), list(numbers), np.array(key, float)


def in_order(slugs: pa.Array, numbers: pa.Array) -> np.ndarray:
    """Each row's place in the order of slugs, then numbers."""
    at = pc.sort_indices(pa.table({"s": slugs, "n": numbers}), sort_keys=[("s", "ascending"), ("n", "ascending")]).to_numpy()
    out = np.empty(len(at), np.int64)
    out[at] = np.arange(len(at))
    return out


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, at): all places from each start on, as many as its count, and which start they belong to."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


class BoundedSums:
    """Exact best rows by summed products of sparse entries: (query, term, weight) held, (row, term, part) batch by batch.

    A term adds at most its weight times the greatest part of a batch. The terms of a query whose bounds together stay
    below the score of its k-th best row so far bring no row in by themselves: only rows with one of its other terms
    are summed, and of these the ones that may still come in are completed. Weights and parts must be positive.

    Queries so few that their weights fill no more than ``CELLS`` of dense matrices are multiplied with those instead
    where that takes less time: a cell costs about a ``CHEAPER``-th of an entry that meets a query's term, bounds included.
    """

    #: Differences of scores that rounding and the order of additions may make.
    SLACK = 1e-9
    CELLS = 1 << 20
    CHEAPER = 1500

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, terms: int, digits: int = 10):
        order = np.argsort(query, kind="stable")
        self.query, self.term, self.weight = query[order], term[order], weight[order]
        self.queries, self.terms, self.digits = queries, terms, digits
        self.products = 0  # made so far
        self.entries = Entries(query, term, weight, queries)
        self.cells = min(queries, self.entries.block) * len(np.unique(query // self.entries.block * terms + term))
        self.matrices: list[tuple[slice, np.ndarray, np.ndarray]] = []  # made by the task

    def offer(self, best: Best, rows: np.ndarray, terms: np.ndarray, parts: np.ndarray, slugs: Sequence[str], numbers: np.ndarray, order: np.ndarray, most: int = 4_000_000) -> None:
        """Give a batch's rows to ``best``, with their scores (rounded) as negative keys; ``most`` products at a time."""
        if not len(terms):
            return
        if self.cells <= self.CELLS and len(order) * self.cells <= self.CHEAPER * np.bincount(terms, minlength=self.terms)[self.term].sum():
            self._offer_dense(best, rows, terms, parts, slugs, numbers, order, most)
            return
        by_term = np.argsort(terms, kind="stable")
        row_of, part_of = rows[by_term], parts[by_term]
        here, start, count = np.unique(terms[by_term], return_index=True, return_counts=True)
        place = np.full(self.terms, -1)
        place[here] = np.arange(len(here))
        at = place[self.term]
        some = at >= 0
        query, at, weight = self.query[some], at[some], self.weight[some]
        bound = weight * np.maximum.reduceat(part_of, start)[at]
        by_bound = np.lexsort((bound, query))
        query, at, weight, bound = query[by_bound], at[by_bound], weight[by_bound], bound[by_bound]
        total = np.cumsum(bound)
        first = np.searchsorted(query, np.arange(self.queries + 1))
        below = total - np.concatenate(([0.0], total))[first[query]]
        weak = below + self.SLACK < -best.worst[query]
        rest = np.zeros(self.queries)
        np.maximum.at(rest, query[weak], below[weak])
        weak_first = first[:-1]  # a query's weak terms come first
        weak_count = np.bincount(query[weak], minlength=self.queries)
        by_row = np.argsort(rows * len(here) + place[terms])
        keys, values = (rows * len(here) + place[terms])[by_row], parts[by_row]
        strong = np.flatnonzero(~weak)
        work = np.cumsum(count[at[strong]])
        n_rows = len(order)
        done = 0
        while done < len(strong):
            # whole queries, about so many products at once
            end = int(np.searchsorted(work, (work[done - 1] if done else 0) + most, "right"))
            end = int(np.searchsorted(query[strong], query[strong[max(done, end - 1)]], "right"))
            own = strong[done:end]
            done = end
            which, places = _spread(start[at[own]], count[at[own]])
            self.products += len(which)
            pairs, of = np.unique(query[own][which] * n_rows + row_of[places], return_inverse=True)
            score = np.bincount(of, weight[own][which] * part_of[places], len(pairs))
            q = pairs // n_rows
            near = score + rest[q] + self.SLACK >= -best.worst[q]
            pairs, score, q = pairs[near], score[near], q[near]
            which, places = _spread(weak_first[q], weak_count[q])
            self.products += len(which)
            wanted = (pairs % n_rows)[which] * len(here) + at[places]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            score += np.bincount(which, np.where(keys[found] == wanted, weight[places] * values[found], 0.0), len(pairs))
            score = np.round(score, self.digits)
            good = score > 0
            best.offer(q[good], (pairs % n_rows)[good], -score[good], slugs, numbers, order)

    def _offer_dense(self, best: Best, rows: np.ndarray, terms: np.ndarray, parts: np.ndarray, slugs: Sequence[str], numbers: np.ndarray, order: np.ndarray, most: int) -> None:
        self.matrices = self.matrices or list(self.entries.blocks())
        for queries, wanted, weights in self.matrices:
            step = max(1, most // max(1, len(wanted)))
            for at in range(0, len(order), step):
                n = min(step, len(order) - at)
                own = (rows >= at) & (rows < at + n)
                score = dense(rows[own] - at, terms[own], parts[own], n, wanted) @ weights
                row, query = np.nonzero((score > 0) & (score + self.SLACK >= -best.worst[queries]))
                score = np.round(score[row, query], self.digits)
                good = score > 0
                best.offer(query[good] + queries.start, row[good] + at, -score[good], slugs, numbers, order)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about so many rows and bytes at most."""
    for batch in batches:
        n = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        yield from (batch.slice(at, n) for at in range(0, batch.num_rows, n))
