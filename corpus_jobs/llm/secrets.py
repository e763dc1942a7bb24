"""Secret scans with column expressions only: fixed patterns, and sliding-window Shannon entropy per character class."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_jobs.llm.common import let, prefix_sums, unused

#: Fixed patterns of the base kinds, in their order; a match counts from so many characters (of the value) on.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE_KINDS = ("assign", "access", "hex")

#: Character classes of the entropy scan: alphabet and least entropy (bits) of a window.
CLASSES = {
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 3.8),
    "entropy_hex": ("0123456789abcdefABCDEF", 3.1),
}
#: A maximal run with a digit; the lookbehind keeps the scan linear.
_RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{%d,}"
#: What looks random but is known not to be secret; a match hides itself and the letters and digits around it.
ALLOW = (r"(?i)example|sample|dummy|placeholder|changeme", r"(?i)0123456789|abcdefgh", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_KINDS = (*BASE_KINDS, *CLASSES)
_SPANS = "array<struct<start:bigint,end:bigint>>"


def find_all(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match) in code points, end exclusive."""
    def placed(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g))
        return let(prefix_sums(steps), lambda at: F.transform(found, lambda m, i: F.struct((F.get(at, i) + F.length(F.get(gaps, i))).alias("start"), F.get(at, i + 1).alias("end"), m.alias("match"))))

    some = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps)))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(text.rlike(pattern), some).otherwise(none)


def peak_entropy(text: Column, alphabet: str, window: int, least: float) -> Column:
    """(peak, first, last, stretches): greatest entropy of a window, first start and last end of windows of ``least`` bits.

    Windows hold ``window`` characters (the whole text where it is shorter), all of the alphabet. Counts follow the
    window one character at a time: with S the sum of c * log2(c), the entropy is log2(w) - S / w. Windows of ``least``
    bits that overlap make a stretch: (first, last, peak) each, in order.
    """
    xlogx = F.array(*[F.lit(0.0 if x < 2 else x * math.log2(x)) for x in range(window + 2)])
    codes = F.transform(F.split(text, ""), lambda ch: F.instr(F.lit(alphabet), ch))
    zeros = F.array_repeat(F.lit(0), len(alphabet) + 1)
    nothing = F.lit(None).cast("int")
    none = F.array().cast("array<struct<first:int,last:int,peak:double>>")

    def closed(a: Column) -> Column:
        return F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))

    def scanned(cs: Column, f: Column, w: Column) -> Column:
        start = F.struct(zeros.alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("run"), F.lit(-1.0).alias("peak"), nothing.alias("first"), F.get(none, F.lit(0)).alias("open"), none.alias("done"))

        def step(a: Column, i: Column) -> Column:
            new, old = F.get(cs, i), F.when(a["run"] >= w, F.get(cs, i - w)).otherwise(F.lit(0))

            def moved(n: Column) -> Column:
                kept = F.transform(n, lambda v, k: v - ((k == old) & (old > 0)).cast("int"))
                gone = F.when(old > 0, F.get(f, F.get(n, old)) - F.get(f, F.get(n, old) - 1)).otherwise(F.lit(0.0))

                def added(m: Column) -> Column:
                    s = a["s"] - gone + F.get(f, F.get(m, new) + 1) - F.get(f, F.get(m, new))
                    run = F.least(a["run"] + 1, w)
                    h = F.when(run == w, F.log2(w) - s / w).otherwise(F.lit(-1.0))
                    up = F.transform(m, lambda v, k: v + (k == new).cast("int"))
                    hit = h >= least - 1e-9
                    on = a["open"]["last"] > i - w + 1
                    grown = F.struct(F.when(on, a["open"]["first"]).otherwise(i - w + 1).alias("first"), (i + 1).alias("last"), F.when(on, F.greatest(a["open"]["peak"], h)).otherwise(h).alias("peak"))
                    return F.struct(up.alias("n"), s.alias("s"), run.alias("run"), F.greatest(a["peak"], h).alias("peak"), F.when(hit & a["first"].isNull(), i - w + 1).otherwise(a["first"]).alias("first"), F.when(hit, grown).otherwise(a["open"]).alias("open"), F.when(hit & ~on, closed(a)).otherwise(a["done"]).alias("done"))

                return let(kept, added)

            reset = F.struct(zeros.alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("run"), a["peak"].alias("peak"), a["first"].alias("first"), a["open"].alias("open"), a["done"].alias("done"))
            return F.when(new == 0, reset).otherwise(moved(a["n"]))

        return F.aggregate(F.sequence(F.lit(0), F.size(cs) - 1), start, step, lambda a: F.struct(a["peak"].alias("peak"), a["first"].alias("first"), a["open"]["last"].alias("last"), closed(a).alias("stretches")))

    return let(codes, lambda cs: let(xlogx, lambda f: let(F.greatest(F.least(F.size(cs), F.lit(window)), F.lit(1)), lambda w: scanned(cs, f, w))))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def _found(kind: int, start: Column, end: Column, entropy: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(kind).alias("order"), F.lit(_KINDS[kind]).alias("kind"), end.cast("long").alias("end"), entropy.alias("entropy"))


def _overlapping(xs: Column, m: Column) -> Column:
    return F.filter(xs, lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"]))


def _bases(text: Column, window: int) -> Column:
    """Findings of the base kinds."""
    wide, least = CLASSES["entropy_base64"]

    def base(kind: int, pattern: str) -> Column:
        at = find_all(text, pattern)
        if kind == 0:
            at = F.filter(at, lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= 8)
        return F.transform(at, lambda m: _found(kind, m["start"], m["end"], peak_entropy(F.regexp_extract(m["match"], ASSIGN, 1) if kind == 0 else m["match"], wide, window, least)["peak"]))

    return F.concat(base(0, ASSIGN), base(1, ACCESS), base(2, HEX))


def _hidden(runs: Column, allow: Sequence[str]) -> Column:
    """Spans of what ``allow`` hides: matches of its patterns within a run, and the letters and digits around them."""
    def hides(m: Column) -> Column:
        known = F.concat(*(find_all(m, pattern) for pattern in allow))
        return let(known, lambda ks: F.when(F.size(ks) == 0, ks).otherwise(F.concat(ks, F.filter(find_all(m, "[A-Za-z0-9]+"), lambda t: F.size(_overlapping(ks, t)) > 0))))

    if not allow:
        return F.array().cast(_SPANS)
    return F.flatten(F.transform(runs, lambda m: F.transform(hides(m["match"]), lambda h: _span(m["start"] + h["start"], m["start"] + h["end"]))))


def _stretches(kind: int, runs: Column, window: int) -> Column:
    """Findings of an entropy kind before anything is cut out of them."""
    alphabet, least = CLASSES[_KINDS[kind]]
    return F.flatten(F.transform(runs, lambda m: F.transform(peak_entropy(m["match"], alphabet, window, least)["stretches"], lambda e: _found(kind, m["start"] + e["first"], m["start"] + e["last"], e["peak"]))))


def _outside(kind: int, stretches: Column, taken: Column, text: Column, window: int) -> Column:
    """What is left of stretches outside ``taken``: the parts that hold a window of enough entropy."""
    alphabet, least = CLASSES[_KINDS[kind]]

    def gaps(x: Column, near: Column) -> Column:
        start = F.struct(x["start"].alias("pos"), F.array().cast(_SPANS).alias("out"))

        def step(a: Column, t: Column) -> Column:
            return F.struct(F.greatest(a["pos"], t["end"]).alias("pos"), F.concat(a["out"], F.array(_span(a["pos"], t["start"]))).alias("out"))

        return F.aggregate(F.array_sort(near), start, step, lambda a: F.concat(a["out"], F.array(_span(a["pos"], x["end"]))))

    def left(x: Column, near: Column) -> Column:
        wide = F.filter(gaps(x, near), lambda g: g["end"] - g["start"] >= window)
        parts = F.transform(wide, lambda g: _found(kind, g["start"], g["end"], peak_entropy(F.substr(text, (g["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int")), alphabet, window, least)["peak"]))
        return F.when(F.size(near) == 0, F.array(x)).otherwise(F.filter(parts, lambda p: p["entropy"] >= least - 1e-9))

    return let(taken, lambda ts: F.flatten(F.transform(stretches, lambda x: let(_overlapping(ts, x), lambda near: left(x, near)))))


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "findings", window: int = 20, allow: Sequence[str] = ALLOW) -> DataFrame:
    """``docs`` with the column ``out`` of findings; a column of that name is replaced.

    Findings are an array of (start, end, kind, entropy), sorted by start, then kind (base kinds first). Base kinds
    always stay. Entropy kinds are stretches of overlapping windows in runs of ``window`` characters or more with a
    digit. Base findings (for hex, base64 ones too) and what ``allow`` hides are cut out of them: matches of its
    patterns within a run, with all of the letters and digits that they are part of. Every part left that holds a
    window of enough entropy is a finding. A null or empty text has none. Each row is scanned by itself: repeated rows
    get repeated findings, an empty table stays empty, and texts of any length are read whole.

    The steps are columns of their own, since the analyzer takes a pass for every level of nested lambdas.
    """
    bases, runs, taken, b64, hexes = (unused(docs, name) for name in ("_bases", "_runs", "_taken", "_b64", "_hexes"))
    t = F.coalesce(F.col(text), F.lit(""))

    def spans(xs: Column) -> Column:
        return F.transform(xs, lambda x: _span(x["start"], x["end"]))

    steps = docs.withColumn(bases, _bases(t, window)).withColumn(runs, find_all(t, _RUN % window))
    steps = steps.withColumn(taken, F.concat(spans(F.col(bases)), _hidden(F.col(runs), allow)))
    steps = steps.withColumn(b64, _stretches(3, F.col(runs), window)).withColumn(hexes, _stretches(4, F.col(runs), window))
    steps = steps.withColumn(b64, _outside(3, F.col(b64), F.col(taken), t, window))
    steps = steps.withColumn(hexes, _outside(4, F.col(hexes), F.concat(F.col(taken), spans(F.col(b64))), t, window))
    merged = F.array_sort(F.concat(bases, b64, hexes))
    found = F.transform(merged, lambda x: F.struct(x["start"], x["end"], x["kind"], x["entropy"]))
    return steps.withColumn(out, found).drop(bases, runs, taken, b64, hexes)


def redact(text: Column, findings: Column, mask: str = "[SECRET]") -> Column:
    """The text with every finding (overlapping ones as one) replaced by ``mask``; null stays null, and what has no findings as it is."""
    def cut(t: Column, fs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            gap = F.array(F.substr(t, (a["pos"] + 1).cast("int"), (x["start"] - a["pos"]).cast("int")), F.lit(mask))
            return F.struct(F.greatest(a["pos"], x["end"]).alias("pos"), F.when(x["start"] >= a["pos"], F.concat(a["out"], gap)).otherwise(a["out"]).alias("out"))

        return F.aggregate(fs, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(t, (a["pos"] + 1).cast("int"))))

    return F.when(F.size(findings) > 0, let(text, lambda t: let(findings, lambda fs: cut(t, fs)))).otherwise(text)
