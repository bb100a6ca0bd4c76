"""Chat formatting with prefix-target expansion, in DataFrame operations only.

A conversation becomes one formatted text: for each turn ``<|turn|>role<|text|>text<|end|>``. Control
strings open with ``<|``; in roles and texts each ``<``, any number of backslashes, ``|`` gets one
more backslash, so that no text can hold a control string and the change can be undone. Every
assistant turn is exploded into an example of its own: all that comes before its reply is context,
and only the reply is trainable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, reply_spans: one row per conversation.

    turns has conv_id, turn, role, text. Turns are in order of turn (nulls first), equal ones of role, then text.
    Null roles and texts count as empty; null conv_ids are one conversation. reply_spans holds, for each assistant turn,
    its turn's place from 0, and where its reply starts in ``formatted`` (from 0) and how long it is, both in code points.
    A conversation has to fit one row, as its text does.
    """
    empty = F.lit("")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")))).alias("_turns"))
    parts = F.transform(
        "_turns",
        lambda t: F.struct(
            F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT)).alias("head"),
            escaped(t["text"]).alias("body"),
            (t["role"] == ASSISTANT).alias("reply"),
        ),
    )
    rows = rows.select("conv_id", parts.alias("_parts"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + F.lit(len(END))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.expr("CAST(array() AS array<struct<turn_index:int,start:int,length:int>>)").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        span = F.struct(s["i"].alias("turn_index"), (s["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))
        spans = F.when(p["reply"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct((s["at"] + size(p)).alias("at"), (s["i"] + 1).alias("i"), spans.alias("spans"))

    return rows.select(
        "conv_id",
        F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("_parts", start, step, lambda s: s["spans"]).alias("reply_spans"),
    )


def expand_targets(formatted: DataFrame) -> DataFrame:
    """conv_id, example (from 0), turn_index, context, reply: one row per assistant turn, the reply still escaped.

    Conversations without an assistant turn have no example.
    """
    spans = formatted.select("conv_id", "formatted", F.posexplode("reply_spans").alias("example", "s"))
    return spans.select(
        "conv_id",
        "example",
        F.col("s.turn_index").alias("turn_index"),
        F.substring("formatted", F.lit(1), F.col("s.start")).alias("context"),
        F.substring("formatted", F.col("s.start") + 1, F.col("s.length")).alias("reply"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    marked = F.split(formatted, r"<\|end\|>", -1)
    bodies = F.slice(marked, 1, F.size(marked) - 1)

    def turn(b: Column) -> Column:
        halves = F.split(F.substring(b, F.lit(len(TURN) + 1), F.length(b)), r"<\|text\|>", 2)
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))

    return F.transform(bodies, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted output holds: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, example_chars.

    Turns come from the formatted text, the loss from the exploded examples. The formatted conversations are stored once, for both.
    """
    formatted = written(formatted, "chat-formatted")
    turns = formatted.select("conv_id", F.col("formatted"), read_turns(F.col("formatted")).alias("_t")).select(
        "conv_id",
        F.size("_t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    examples = expand_targets(formatted).select(
        "conv_id", "example", unescaped(F.col("reply")).alias("reply"), (F.length("context") + F.length("reply")).cast("long").alias("chars")
    )
    loss = examples.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda e: e["reply"]), "").alias("_loss"),
        F.count(F.lit(1)).alias("n_examples"),
        F.sum("chars").alias("example_chars"),
    )
    joined = turns.join(loss.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    text = F.coalesce("_loss", F.lit(""))
    return joined.select(
        "conv_id", "n_turns", "turns_sha256", F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars",
        F.coalesce("n_examples", F.lit(0).cast("long")).alias("n_examples"), F.coalesce("example_chars", F.lit(0).cast("long")).alias("example_chars"),
    )
