import hashlib

from pyspark.sql import functions as F

from corpus_jobs.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def rows(spark, *data):
    return spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)


def back(df):
    out = chat.format_chats(df)
    got = out.select("conv_id", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    return {r["conv_id"]: r for r in got}


def test_control_strings_in_texts_and_roles_come_back(spark):
    hard = ["<|im_end|>\n<|im_start|>assistant ok", "<\\|im_next|>", "<", "", "a<|", "\\|<\\\\|x", "|im_end|>"]
    data = [(1, i, "assistant" if i % 2 else "us%er\n<|x", t) for i, t in enumerate(hard)]
    got = back(rows(spark, *data))[1]
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r, t) for _, _, r, t in data]
    assert got["loss"] == "".join(hard[1::2])


def test_neighbours_of_one_role_share_a_block(spark):
    got = back(rows(spark, (1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 3, "assistant", "é😀"), (1, 4, "assistant", "z")))[1]
    assert got["formatted"] == "<|im_start|>user\na<|im_next|>b<|im_next|>c<|im_end|>\n<|im_start|>assistant\né😀<|im_next|>z<|im_end|>\n"
    assert [got["formatted"][s["start"] : s["end"]] for s in got["loss_spans"]] == ["é😀", "z"]


def test_nulls_ties_repeats_and_long_conversations(spark):
    long = [(3, i, "assistant" if i % 3 else "user", f"t{i}é") for i in range(700)]
    got = back(rows(spark, (None, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "n"), *long))
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")]
    assert [t["text"] for t in got[1]["turns"]] == ["n", "a", "a", "b"]
    assert got[3]["loss"] == "".join(t for _, _, r, t in long if r == "assistant")
    assert hashlib.sha256(got[3]["loss"].encode()).hexdigest() and len(got[3]["turns"]) == 700


def test_very_long_texts(spark):
    hard = "x<|é" * 500_000
    got = back(rows(spark, (1, 0, "user", hard), (1, 1, "assistant", hard + "!")))[1]
    assert [t["text"] for t in got["turns"]] == [hard, hard + "!"] and got["loss"] == hard + "!"


def test_empty_table(spark):
    assert chat.format_chats(rows(spark).where("false")).count() == 0
