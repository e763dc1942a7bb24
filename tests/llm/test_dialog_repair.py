import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_jobs.llm import dialog_repair
from corpus_jobs.llm.dialog_repair import FAULTS, INITIALS

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FOLLOWS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
NAMES = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) over all edits of rows (role, fault), by the least path to every state."""
    def inserted(paths):
        for _ in range(3):
            for state, (cost, audit) in list(paths.items()):
                paths[NEXT[state]] = min(paths.get(NEXT[state], (cost + 4, "")), (cost + 3, audit + "I"))
        return paths

    paths = {"": (0, "")}
    for role, fault in rows:
        found = {}
        for state, (cost, audit) in inserted(dict(paths)).items():
            edits = [(state, 4, "D")]
            if fault != "d":
                more = 3 if fault == "t" else 0
                edits += [(role[0], more, "K")] if (state, role[:1]) in FOLLOWS else []
                edits.append((NEXT[state], 3 + more, "R"))
            for to, price, edit in edits:
                found[to] = min(found.get(to, (cost + price, audit + edit)), (cost + price, audit + edit))
        paths = found
    paths = inserted(dict(paths))
    return min(paths[state] for state in ("", "a") if state in paths)


def brute(rows):
    """What plan_repairs and repaired_turns give for rows (conv, turn, role, text)."""
    plans, turns = {}, {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{'' if conv is None else conv}:{str(conv is None).lower()}:{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            solid = text.strip(SPACES)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none")
            seen.add((role, text))
        numbers = {t for t, *_ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = cheapest([(role, {"none": "n", "truncated": "t"}.get(f, "d")) for (_, role, _), f in zip(own, faults, strict=True)])
        plans[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit)
        state, left, lines = "", list(own), []
        for edit in audit:
            row = left.pop(0) if edit != "I" else (None, None, "")
            if edit == "D":
                continue
            state = row[1][0] if edit == "K" else NEXT[state]
            lines.append((edit, row[1] if edit == "K" else NAMES[state], row[2]))
        turns[conv] = lines
    return plans, turns


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(INITIALS), st.sampled_from("nnndt"), st.integers(1, 4)), max_size=6))
def test_edits_are_the_cheapest_and_the_first_of_these(runs):
    rows = [(initial, fault) for initial, fault, n in runs for _ in range(n)]
    assert dialog_repair.repair("".join(dialog_repair.symbol_of(*r) for r in rows)) == cheapest(rows)


def test_long_runs_by_powers():
    symbols = dialog_repair.symbol_of("u", "n") * 3000 + dialog_repair.symbol_of("x", "t") * 2001
    rows = [("u", "n")] * 3000 + [("x", "t")] * 2001
    assert dialog_repair.repair(symbols) == cheapest(rows)
    assert all(dialog_repair._read_symbol(dialog_repair.symbol_of(i, f)) == (i, f) for i in INITIALS for f in FAULTS)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"audit": F.lit(1), "key": F.lit("x"), "symbols": F.lit(2)}).repartition(parts)


def hostile():
    rng = random.Random(7)
    rows = []
    for conv in (None, 1, 2, 3):
        for turn in [None, None, *range(20 if conv != 3 else 600)]:
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                rows.append((conv, turn if turn is None else turn * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "system", "tool", None, "", "a", "uu"]), rng.choice(["hi.", "ok?", "no", None, "", " \t", "wow! ", "same.", "é\nß.", "x" * 100_000 + "."])))
    return rows + rows[:5]


def digest(lines):
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in lines).encode()).hexdigest()


def test_conversations_over_many_partitions(spark):
    rows = hostile()
    turns = table(spark, rows)
    plans, texts = brute(rows)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        planned = spark.createDataFrame(dialog_repair.plan_repairs(turns).collect(), "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
        assert {r["conv_id"]: tuple(r)[1:] for r in planned.collect()} == plans
        got = {conv: [] for conv in plans}
        for r in sorted(dialog_repair.repaired_turns(turns, planned).collect(), key=lambda r: r["position"]):
            assert r["position"] == len(got[r["conv_id"]])
            got[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
        assert got == texts
        assert {r[0]: r[1] for r in dialog_repair.repaired_digests(turns, planned).collect()} == {c: digest(x) for c, x in texts.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_conversation_may_take_many_partitions(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"{t % 50}." if t % 7 else "cut") for t in range(4000)]
    marked = dialog_repair._marked(table(spark, rows), "conv_id", "turn", "role", "text").withColumn("later", F.lit(False))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = marked.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "key")
        assert dialog_repair._segments(ordered).count() > 1
        found = dialog_repair.plan_repairs(table(spark, rows)).first()
        assert tuple(found)[1:] == brute(rows)[0][1]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_table(spark):
    turns = table(spark, [(1, 1, "user", "x")]).where("false")
    plans = dialog_repair.plan_repairs(turns)
    assert plans.count() == 0 and dialog_repair.repaired_digests(turns, plans).count() == 0


@pytest.mark.parametrize("text,how", [("a. b? c!", {1: "", 2: "a b c"})])
def test_damage(spark, text, how):
    import zlib

    rows = [(c, t, "assistant", text) for c in (None, 1, 2) for t in [None, *range(40)]]
    want = []
    for c, t, role, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            want += [(c, t, "user" if k == 4 else role, how.get(k, x))] * (2 if k == 3 else 1)
    got = [tuple(r) for r in dialog_repair.damaged(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
