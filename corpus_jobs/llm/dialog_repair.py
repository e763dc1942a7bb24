"""Conversation structure repair: the cheapest edits that make roles alternate, by a run-length min-plus dynamic program.

A conversation's rows become a string of symbols, one for each row: its role's initial and its fault. The program knows
four states (nothing yet, after a system, a user, an assistant turn). A symbol is a 4 x 4 matrix of costs, a run of equal
symbols a power of it; powers of two are kept. Costs to the end are known at every run's end, then the edits are
unrolled, row by row, the first in ASCII order among the cheapest.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_jobs.llm.common import SPACES, join_counted, materialise, small

#: Costs of edits, and what a truncated row adds that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
#: From each state: the turn that an edit may add, and the states that a role's initial leads to.
_NEXT = {_NOTHING: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_BY_INITIAL = {(_NOTHING, "s"): _SYSTEM, (_NOTHING, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
_LEGAL = ("su", "ua", "au")
#: Initials of roles and faults of rows; a symbol is one character for both.
INITIALS, FAULTS = "suax", "ndt"  # x: any other; none, to be deleted, truncated

Vector = tuple[float, ...]


def symbol_of(initial: str, fault: str) -> str:
    """The character for a role's initial (of INITIALS) and a fault (of FAULTS)."""
    return chr(65 + INITIALS.index(initial) * len(FAULTS) + FAULTS.index(fault))


def _read_symbol(s: str) -> tuple[str, str]:
    initial, fault = divmod(ord(s) - 65, len(FAULTS))
    return INITIALS[initial], FAULTS[fault]


def _steps(state: int, s: str) -> Iterator[tuple[str, int, int]]:
    """(edit, next state, cost) of what may be done with a row, in ASCII order."""
    initial, fault = _read_symbol(s)
    yield "D", state, DELETE
    if fault != "d":
        more = TRUNCATED if fault == "t" else 0
        if (state, initial) in _BY_INITIAL:
            yield "K", _BY_INITIAL[state, initial], more
        yield "R", _NEXT[state], REROLE + more


@cache
def _inserted() -> tuple[Vector, ...]:
    """Least costs from state to state by inserted turns alone."""
    cost = [[0.0 if i == j else math.inf for j in range(4)] for i in range(4)]
    for state in range(4):
        at = state
        for n in range(1, 4):
            at = _NEXT[at]
            cost[state][at] = min(cost[state][at], n * INSERT)
    return tuple(map(tuple, cost))


def _product(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(x + y for x, y in zip(row, column, strict=True)) for column in zip(*b, strict=True)) for row in a)


@cache
def _power(s: str, k: int) -> tuple[Vector, ...]:
    """The matrix of 2 ** k rows of a symbol, turns inserted before each of them."""
    if k:
        return _product(_power(s, k - 1), _power(s, k - 1))
    own = [[math.inf] * 4 for _ in range(4)]
    for state in range(4):
        for _, then, cost in _steps(state, s):
            own[state][then] = min(own[state][then], cost)
    return _product(_inserted(), tuple(map(tuple, own)))


def _before(matrix: tuple[Vector, ...], after: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, after, strict=True)) for row in matrix)


def _over(s: str, n: int, after: Vector) -> Vector:
    """Costs to the end before ``n`` rows of a symbol, from those after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = _before(_power(s, k), after)
    return after


@lru_cache(65_536)
def _choice(s: str, after: Vector, state: int) -> tuple[str, int]:
    """The edits of a row with the insertions before it, and the state after it, given the costs after it."""
    here, edits = _before(_power(s, 0), after), ""
    while True:
        if DELETE + after[state] == here[state]:
            return edits + "D", state
        if INSERT + here[_NEXT[state]] == here[state]:
            edits, state = edits + "I", _NEXT[state]
            continue
        edit, state = next((edit, to) for edit, to, cost in _steps(state, s) if cost + after[to] == here[state])
        return edits + edit, state


def _lowered(costs: Vector) -> Vector:
    least = min(costs)
    return tuple(x - least for x in costs)


def _path(s: str, n: int, after: Vector) -> tuple[array, list[Vector]]:
    """The numbers of the costs, less their minimum, after the last of ``n`` rows, the one before it and so on, and what they stand for.

    These are few, and each follows from the one after it, so a row takes two bytes.
    """
    known, follows = [_lowered(after)], []
    path = array("H", [0])
    for _ in range(n - 1):
        at = path[-1]
        if at == len(follows):
            before = _lowered(_before(_power(s, 0), known[at]))
            if before not in known:
                known.append(before)
            follows.append(known.index(before))
        path.append(follows[at])
    return path, known


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", symbols)]


def repair(symbols: str) -> tuple[int, str]:
    """(cost, audit): the cheapest edits of a conversation's rows, the first in ASCII order where several cost as much.

    Edits are Keep, Rerole, Delete and Insert by their initials. Symbols come from ``symbol_of``; none give no edits.
    """
    parts = runs(symbols)
    costs = [tuple(min(cost[state] for state in (_NOTHING, _ASSISTANT)) for cost in _inserted())]
    for s, n in reversed(parts):
        costs.append(_over(s, n, costs[-1]))
    costs.reverse()
    audit, state = [], _NOTHING
    for (s, n), after in zip(parts, costs[1:], strict=True):
        path, known = _path(s, n, after)
        for number in reversed(path):
            edits, state = _choice(s, known[number], state)
            audit.append(edits)
    left = int(costs[-1][state])
    audit.append("I" * (left // INSERT))
    return int(costs[0][_NOTHING]), "".join(audit)


def illegal_pairs(symbols: str) -> int:
    """How many neighbours have roles that may not follow each other; rows of one role never may."""
    parts = [_read_symbol(s)[0] for s, _ in runs(symbols)]
    return max(0, len(symbols) - 1) - sum(a + b in _LEGAL for a, b in zip(parts, parts[1:], strict=False))


def _marked(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with their role's initial, what is wrong with the text alone, and a digest of conversation, role and text."""
    space = F.lit(" ")
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
    whole = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("conv_id").isNull().cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    first = F.substring("role", 1, 1)
    return rows.select(
        "*",
        F.when(first.isin(*INITIALS[:3]), first).otherwise(INITIALS[3]).alias("initial"),
        F.btrim("text", F.lit(SPACES)).alias("_solid"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("key"),
    ).select("*", (F.col("_solid") == "").alias("blank"), (~F.substring("_solid", -1, 1).isin(".", "!", "?")).alias("truncated")).drop("_solid")


_SEGMENT = "seg int, symbols string, blank bigint, duplicate bigint, truncated bigint, first bigint, last bigint, distinct bigint"


def _segments(sorted_rows: DataFrame) -> DataFrame:
    """A row for each conversation in each partition of rows in order: its symbols, counts of faults, and its turns."""
    kind = sorted_rows.schema["conv_id"].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg, done = TaskContext.get().partitionId(), []
        open_: dict | None = None
        before = None

        def flushed() -> pa.RecordBatch:
            columns = {name: [d[name] for d in done] for name in ("conv_id", "blank", "duplicate", "truncated", "first", "last", "distinct")}
            columns["symbols"], columns["seg"] = [bytes(d["symbols"]).decode() for d in done], [seg] * len(done)
            done.clear()
            fields = [batch_schema.field("conv_id"), *(pa.field(n, pa.int32() if n == "seg" else pa.string() if n == "symbols" else pa.int64()) for n in ("seg", "symbols", "blank", "duplicate", "truncated", "first", "last", "distinct"))]
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in fields], schema=pa.schema(fields))

        for batch in small(batches):
            batch_schema = batch.schema
            for conv_id, turn, key, initial, blank, truncated, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or open_["conv_id"] != conv_id:
                    if open_ is not None:
                        done.append(open_)
                    open_, before = {"conv_id": conv_id, "symbols": bytearray(), "blank": 0, "duplicate": 0, "truncated": 0, "first": turn, "last": None, "distinct": 0}, None
                fault = "blank" if blank else "duplicate" if later or before == (turn, key) else "truncated" if truncated else None
                if fault:
                    open_[fault] += 1
                open_["symbols"] += symbol_of(initial, "t" if fault == "truncated" else "d" if fault else "n").encode()
                if turn is not None and turn != open_["last"]:
                    open_["distinct"] += 1
                    open_["first"] = turn if open_["first"] is None else open_["first"]
                    open_["last"] = turn
                before = turn, key
            if done:
                yield flushed()
        if open_ is not None:
            done.append(open_)
            yield flushed()

    return sorted_rows.select("conv_id", "turn", "key", "initial", "blank", "truncated", "later").mapInArrow(segments, f"conv_id {kind}, {_SEGMENT}")


def _gaps(parts: list[dict]) -> int:
    """How many turns are missing between the first and the last of a conversation's segments in order."""
    turns = [(p["first"], p["last"], p["distinct"]) for p in parts if p["distinct"]]
    if not turns:
        return 0
    distinct = sum(n for *_, n in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))
    return min(turns[-1][1] - turns[0][0] + 1 - distinct, 2**63 - 1)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plan_repairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    Rows go by turn, nulls first, then role, then a digest of the text; a null role or text counts as one space. A row's
    first fault counts: blank text, role and text seen earlier in the conversation, or an end without one of ``.!?``.
    Repeated rows are duplicates, conversations of a null id are one conversation. An empty table gives no rows; other
    columns aren't read, whatever their names.

    Rows without their texts are sorted over all tasks, so that a conversation may take many of them; the rows that a
    task has of it become a string of a byte each. These strings meet in one row, as the audit is one value, too.
    """
    marked = _marked(turns, conv, turn, role, text)
    when = F.struct("turn")
    repeats = marked.groupBy("key").agg(F.min(when).alias("_first"), F.max(when).alias("_last"), F.count("*").alias("_n")).where("_first != _last").drop("_last")
    rows = join_counted(marked.drop("text"), materialise(repeats, "repeats"), "key", "_n", "left")
    rows = rows.withColumn("later", F.coalesce(when > F.col("_first"), F.lit(False)))
    ordered = rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "key")
    whole = _segments(ordered).groupBy("conv_id").agg(*(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")), F.array_sort(F.collect_list(F.struct("seg", "symbols", "first", "last", "distinct"))).alias("parts"))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            parts = batch.column("parts").to_pylist()
            symbols = ["".join(p["symbols"] for p in ps) for ps in parts]
            found = [repair(s) for s in symbols]
            of = {"gaps": [_gaps(ps) for ps in parts], "illegal": [illegal_pairs(s) for s in symbols], "cost": [c for c, _ in found]}
            columns = [batch.column(n) if n in ("blank", "duplicate", "truncated") else pa.array(of[n], pa.int64()) for n in _COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns, pa.array([a for _, a in found], pa.string())], names=["conv_id", *_COUNTS, "audit"])

    kind = turns.schema[conv].dataType.simpleString()
    return whole.mapInArrow(planned, ", ".join([f"conv_id {kind}", *(f"{n} bigint" for n in _COUNTS), "audit string"]))


class _Editor:
    """Applies an audit to a conversation's rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _NOTHING

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, _NEXT[self.state]
            yield "I", _NAMES[self.state], ""

    def edited(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what comes of a row and of the insertions before it."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _BY_INITIAL[self.state, role[0]]
            yield edit, role, text
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield edit, _NAMES[self.state], text


def _ahead(turns: DataFrame, plans: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Every conversation's audit and then its rows in order, in one partition."""
    rows = _marked(turns, conv, turn, role, text).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "key", "text")
    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema[turn].dataType).alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("key"), F.col("audit").alias("text"))
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "key").select("conv_id", "kind", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, list[tuple[str, str, str]], bool]]:
    """(ids, row, turns that come of it, whether the conversation ends with it) for the rows of ``_ahead``, one after another.

    A conversation's end is known at the next head, so its last turns come with that head's row before it.
    """
    editor, ids, row = None, None, 0
    for batch in small(batches):
        for i, (kind, role, text) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("kind", "role", "text")), strict=True)):
            if kind == 0:
                if editor is not None:
                    yield ids, row, list(editor.inserted()), True
                editor, ids, row = _Editor(text), batch.column("conv_id"), i
            else:
                yield ids, row, list(editor.edited(role, text)), False
    if editor is not None:
        yield ids, row, list(editor.inserted()), True


def repaired_turns(turns: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, edit, role, text): the turns that are left and those inserted, by the audits of plan_repairs (written).

    Rows stream through their task in order; of a conversation only its audit is kept. The rest is as in plan_repairs.
    """
    kind = turns.schema[conv].dataType.simpleString()

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = 0
        for ids, row, made, over in _conversations(batches):
            if made:
                n = len(made)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([row] * n)), pa.array(range(position, position + n), pa.int64()), *(pa.array(list(x), pa.string()) for x in zip(*made, strict=True))], names=["conv_id", "position", "edit", "role", "text"])
            position = 0 if over else position + len(made)

    return _ahead(turns, plans, conv, turn, role, text).mapInArrow(rendered, f"conv_id {kind}, position bigint, edit string, role string, text string")


def repaired_digests(turns: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, repaired_sha256): lower-case hex of the repaired conversation's ``role:text``, joined by newlines; see repaired_turns."""
    kind = turns.schema[conv].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, some = hashlib.sha256(), False
        for ids, row, made, over in _conversations(batches):
            for _, role_, text_ in made:
                sha.update(f"{chr(10) if some else ''}{role_}:{text_}".encode())
                some = True
            if over:
                yield pa.RecordBatch.from_arrays([ids.slice(row, 1), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])
                sha, some = hashlib.sha256(), False

    return _ahead(turns, plans, conv, turn, role, text).mapInArrow(digests, f"conv_id {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with every fifth or so of its rows spoilt, the same ones each time: dropped, emptied, cut, repeated, of another role."""
    space = F.lit(" ")
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(place.cast("binary")) % 20).alias("how")).where("how != 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")
