"""Chat formatting: turns sorted in arrays, neighbours of one role merged, concatenated with a reversible template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_jobs.llm.common import let, prefix_sums

OPEN, NEXT, CLOSE = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
_CLOSE_RE, _NEXT_RE = r"<\|im_end\|>\n", r"<\|im_next\|>"


def escape(text: Column) -> Column:
    """Put one more backslash between ``<`` and ``|``, so that no control string is left in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points, end exclusive).

    Turns are sorted by turn, then role and text, nulls first; repeated rows stay. A null role or text counts as
    empty; rows of a null conversation form one conversation. Turns of one role that follow each other share a block
    and are set apart by NEXT, which reading back undoes. Loss spans hold the texts of ``loss_roles`` only.
    Other columns are not read. An empty table gives no rows. A conversation is one row, so it must fit one.
    """
    empty = F.lit("")
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def blocks(ts: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"]))

        def block(ss: Column) -> Column:
            return F.transform(ss, lambda s, k: F.struct(F.get(ts, s)["role"].alias("role"), F.transform(F.slice(ts, s + 1, F.coalesce(F.get(ss, k + 1), F.size(ts)) - s), lambda t: escape(t["text"])).alias("texts")))

        return let(starts, block)

    def plain(s: Column) -> Column:
        return F.struct(s.alias("s"), F.lit(False).alias("loss"))

    def parts(block: Column) -> Column:
        loss = block["role"].isin(*loss_roles)
        texts = F.flatten(F.transform(block["texts"], lambda x, j: F.array(plain(F.when(j == 0, "").otherwise(NEXT)), F.struct(x.alias("s"), loss.alias("loss")))))
        return F.concat(F.array(plain(F.concat(F.lit(OPEN), _escape_role(block["role"]), F.lit("\n")))), texts, F.array(plain(F.lit(CLOSE))))

    def laid_out(ps: Column) -> Column:
        at = prefix_sums(F.transform(ps, lambda p: F.length(p["s"])))
        spans = let(at, lambda a: F.transform(ps, lambda p, i: F.struct(F.get(a, i).alias("start"), F.get(a, i + 1).alias("end"), p["loss"].alias("loss"))))
        spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.struct(F.array_join(F.transform(ps, lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))

    out = let(let(F.col("turns"), lambda ts: F.flatten(F.transform(blocks(ts), parts))), laid_out)
    return sorted_turns.select("conv_id", out.alias("o")).select("conv_id", "o.formatted", "o.loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), merged turns apart again."""
    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = _unescape_role(F.substr(head, F.lit(len(OPEN) + 1)))
        body = F.substr(block, F.length(head) + 2)
        return let(role, lambda r: F.transform(F.split(body, _NEXT_RE), lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))

    return let(F.split(formatted, _CLOSE_RE), lambda bs: F.flatten(F.transform(F.slice(bs, F.lit(1), F.size(bs) - 1), turns)))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, with nothing between."""
    return let(formatted, lambda f: F.array_join(F.transform(spans, lambda s: unescape(F.substr(f, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""))
