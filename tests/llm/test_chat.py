import hashlib

import pytest
from pyspark.sql import functions as F

from stratalog.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
LONG = "word <|end|> " * 30_000
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", ""),
    (2, 0, "user", "only a question"),
    (3, 0, "assistant", "<|turn|>assistant<|text|>x<|end|>"), (3, 1, "assistant", "<\\|end|> <\\\\|text|> <| |> \\"), (3, 2, "<|text|>", "<|\\"),
    (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a"), (4, 1, "user", "a"), (4, None, "user", "first"),
    (5, 0, None, None), (5, 1, "assistant", None), (5, None, None, "x"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "none"),
    (6, 0, "user", LONG), (6, 1, "assistant", LONG), (6, 2, "assistant", "é中\U0001f600 \n\x00"),
    (7, 0, "Assistant", "not the role"), (7, 1, "assistant ", "nor this"),
]


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(r == "assistant" for *_, r, _ in turns)))
    return sorted(map(repr, out))


def test_edge_conversations_against_brute_force(spark):
    rows = spark.createDataFrame(TURNS, SCHEMA)
    got = chat.read_back(chat.format_conversations(rows)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "n_examples").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(TURNS)


def test_clashing_columns_are_ignored(spark):
    rows = spark.createDataFrame(TURNS, SCHEMA)
    for name in ("_turns", "_parts", "formatted", "reply_spans", "example", "_t", "_loss"):
        rows = rows.withColumn(name, F.lit("own"))
    got = chat.format_conversations(rows)
    assert got.columns == ["conv_id", "formatted", "reply_spans"] and got.count() == 8


def test_every_reply_is_an_example_with_all_before_it(spark):
    formatted = chat.format_conversations(spark.createDataFrame(TURNS, SCHEMA))
    whole = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    examples = chat.expand_targets(formatted).collect()
    assert len(examples) == sum(r == "assistant" for _, _, r, _ in TURNS)
    for e in examples:
        assert whole[e["conv_id"]].startswith(e["context"] + e["reply"] + chat.END) and e["context"].endswith(f"{chat.TURN}assistant{chat.TEXT}")
        assert e["context"].count(chat.TURN) == e["turn_index"] + 1
    one = sorted((e["example"], e["context"], e["reply"]) for e in examples if e["conv_id"] == 1)
    assert one[0] == (0, "<|turn|>user<|text|>hi<|end|><|turn|>assistant<|text|>", "hello")
    assert one[1][1].startswith("<|turn|>user<|text|>hi<|end|><|turn|>assistant<|text|>hello<|end|><|turn|>user<|text|>more<|end|>") and one[1][2] == ""


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.format_conversations(none).isEmpty() and chat.read_back(chat.format_conversations(none)).isEmpty()


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|", "<|<|", "<\\|\\<|\\|>", "<", "|", "\\|", "<\\\\\\"])
def test_escapes_can_be_undone(spark, text):
    row = spark.range(1).select(chat.escaped(F.lit(text)).alias("e")).select("e", chat.unescaped(F.col("e")).alias("u")).first()
    assert row["u"] == text and "<|" not in row["e"]
