"""Chat formatting whose output is parsed back and compared before it is kept.

Built from DataFrame expressions only. A turn is written as ``<|im_start|>role`` newline ``text<|im_end|>``
newline. Inside texts a control opener is told apart by a backslash: ``<|`` is written ``<\\|``, and one
that already carries backslashes gets one more, so reading back removes exactly what writing added.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_SPLIT = r"<\|im_start\|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on one line: backslash, newline and bar are written as two characters."""
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    pieces = F.split(role, r"\\\\", -1)
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|")))
    return F.array_join(plain, "\\")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def _parse_turn(piece: Column) -> Column:
    body = F.substr(piece, F.lit(1), F.length(piece) - len(END))
    head = F.substring_index(body, "\n", 1)
    whole = F.endswith(piece, F.lit(END)) & F.contains(body, F.lit("\n")) & ~F.contains(body, F.lit(END.strip()))
    return F.struct(
        F.when(whole, unescape_role(head)).alias("role"),
        F.when(whole, unescape_text(F.substr(body, F.length(head) + 2))).alias("text"),
    )


def parse_conversation(formatted: Column) -> Column:
    """The deterministic grammar: ``array<struct<role, text>>``; a malformed turn has nulls in it."""
    pieces = F.split(formatted, _SPLIT, -1)
    return F.transform(F.slice(pieces, 2, F.size(pieces)), _parse_turn)


def _written(turn: Column) -> Column:
    """The turn as it is written: plain where that reads back the same, else escaped.

    The escaped form always reads back; the last branch only guards the grammar itself.
    """
    source = F.array(F.struct(turn["role"].alias("role"), turn["text"].alias("text")))
    forms = [(turn["role"], turn["text"]), (escape_role(turn["role"]), escape_text(turn["text"]))]
    chosen = None
    for role, text in forms:
        same = parse_conversation(render_turn(role, text)) == source
        form = F.struct(role.alias("role"), text.alias("text"), (turn["role"] == "assistant").alias("loss"))
        chosen = F.when(same, form) if chosen is None else chosen.when(same, form)
    return chosen


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``parts``.

    ``parts`` is ``array<struct<text, loss>>``; joined in order its texts are ``formatted``, and ``loss``
    marks what a model is trained to write (the assistant's texts, still escaped).

    Turns come in order of the turn number, nulls first; equal numbers in order of role and text, and
    repeated rows are kept. A null role or text is empty. Rows without a conversation id form one
    conversation with a null id. No rows give no rows. Other columns are not read. The job fails if a
    conversation does not read back as its source, which the escapes rule out.
    """
    picked = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = picked.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = grouped.withColumn("written", F.transform("turns", _written))
    parts = F.flatten(
        F.transform(
            "written",
            lambda w: F.array(
                F.struct(F.concat(F.lit(START), w["role"], F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
                F.struct(w["text"].alias("text"), w["loss"].alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    formatted = written.withColumn("parts", parts).withColumn("formatted", F.array_join(F.transform("parts", lambda p: p["text"]), ""))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(parse_conversation(F.col("formatted")) == source, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    )
    return formatted.select("conv_id", checked.alias("formatted"), "parts")


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["loss"]), lambda p: unescape_text(p["text"])), "")
