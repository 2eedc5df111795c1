"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into one
block by an array aggregation, and blocks are concatenated. The template is

    ``<|role:NAME|>`` text ``<|next|>`` text ... ``<|end|>`` newline

a block for each run of a role, ``<|next|>`` between the turns that it merges. In texts and roles, ``&`` is written
``&amp;`` and ``<|`` is written ``&lt;|`` (``|>`` in a role: ``|&gt;``), so that no text can hold a mark and both can be undone. The loss mask is
an array of (start, length) in code points of the output: the texts of turns of ``loss_role``, marks left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the template.
OPEN, NAMED, NEXT, END = "<|role:", "|>", "<|next|>", "<|end|>\n"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv, n_turns, n_blocks, formatted, loss): a row for each conversation.

    Null texts and roles are empty; turns sort by number (null first), then role, then text, so repeated rows and
    ties have one order. An empty table gives no rows; rows without a conversation id form one conversation. A
    conversation is one output row and so one task's work; other columns are ignored.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = rows.groupBy(F.col(conv).alias(conv)).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text")))).alias("turns"))
    # pieces in output order: for each turn, the mark before it and its text; the mark says whether a block goes on
    opened = lambda t: F.concat(F.lit(OPEN), F.replace(escaped(t["role"]), F.lit(NAMED), F.lit("|&gt;")), F.lit(NAMED))
    pieces = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.when(i == 0, opened(t)).when(F.col("turns")[i - 1]["role"] == t["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), opened(t))).alias("mark"),
            escaped(t["text"]).alias("text"),
            (t["role"] == loss_role).alias("loss"),
        ),
    )
    done = turns.select(conv, F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    lengths = F.transform("pieces", lambda p: F.struct(F.char_length(p["mark"]).cast("long").alias("mark"), F.char_length(p["text"]).cast("long").alias("text"), p["loss"].alias("loss")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    step = lambda a, p: F.struct(
        (a["at"] + p["mark"] + p["text"]).alias("at"),
        F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["mark"]).alias("start"), p["text"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    return done.select(
        conv,
        "n_turns",
        F.size(F.filter("pieces", lambda p: p["mark"] != NEXT)).cast("long").alias("n_blocks"),
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(END)).alias("formatted"),
        F.aggregate(lengths, start, step, lambda a: a["spans"]).alias("loss"),
    )


def read_chats(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns array<struct<role,text>>, loss_text, formatted_chars), read from ``formatted`` and its mask."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda b: b != "")
    at = lambda b: F.instr(b, F.lit(NAMED))
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, at(b) + len(NAMED)), r"<\|next\|>"),
                lambda t: F.struct(unescaped(F.replace(F.substr(b, F.lit(len(OPEN) + 1), at(b) - len(OPEN) - 1), F.lit("|&gt;"), F.lit(NAMED))).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select(conv, turns.alias("turns"), loss.alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def digest(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The contract's columns from what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col(conv).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
