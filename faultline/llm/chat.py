"""Chat formatting with Spark expressions only.

Turn structs are collected and sorted, adjacent turns of one role are merged by
array functions, and the parts are concatenated.  The template is::

    <|im_start|>role LF text [<|im_sep|> text ...] <|im_end|> LF

A merged turn keeps its texts apart by ``<|im_sep|>``.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|`` (in roles, a line feed becomes
backslash n), so no text can contain a control string and all is reversible.
A conversation is one string by definition and hence one row; conversations
are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape(text: Column, role: bool = False) -> Column:
    def part(p: Column) -> Column:
        p = F.replace(p, F.lit("\\|"), F.lit("|"))
        return F.replace(p, F.lit("\\n"), F.lit("\n")) if role else p

    parts = F.transform(F.split(text, r"\\\\", -1), part)
    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.array_join(parts, "\\"))


def format_chat(conversations: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conv_id: conv_id, segments, formatted.

    ``segments`` is an array of (piece, loss): the pieces concatenate to
    ``formatted`` and ``loss`` marks the texts of ``trained_roles``.  Rows go by
    turn, then role, then text (nulls first); null roles and texts are empty;
    repeated rows are repeated turns; a null conv_id is a conversation of its
    own; other columns are ignored.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.select("conv_id", turn.alias("_t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    t = F.col("_turns")
    starts = F.filter(
        F.sequence(F.lit(0), F.size(t) - 1),
        lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]),
    )
    with_starts = turns.withColumn("_starts", starts)
    s = F.col("_starts")
    blocks = F.transform(s, lambda a, k: F.slice(t, a + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - a))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("piece"), loss.alias("loss"))

    no = F.lit(False)

    def segments(block: Column) -> Column:
        role = F.get(block, F.lit(0))["role"]
        head = F.array(piece(F.concat(F.lit(START), _escape_role(role), F.lit("\n")), no))
        body = F.flatten(
            F.transform(
                block,
                lambda x, i: F.concat(
                    F.when(i > 0, F.array(piece(F.lit(SEP), no))).otherwise(F.array().cast("array<struct<piece:string,loss:boolean>>")),
                    F.array(piece(_escape(x["text"]), role.isin(*trained_roles))),
                ),
            )
        )
        return F.concat(head, body, F.array(piece(F.lit(END + "\n"), no)))

    out = with_starts.select("conv_id", F.flatten(F.transform(blocks, segments)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["piece"]), ""))


def parse_chat(formatted: Column) -> Column:
    """The turns, array of (role, text), read back from a formatted string."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b, i: i > 0)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring_index(F.substr(block, F.length(role) + 2), END, 1)
        return F.transform(
            F.split(body, r"<\|im_sep\|>", -1),
            lambda x: F.struct(_unescape(role, role=True).alias("role"), _unescape(x).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped and without anything between."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: _unescape(x["piece"])), "")
