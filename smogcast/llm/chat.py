"""Chat formatting with a grammar that reads back: render, reparse, compare, escape until identical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: <|im_start|>role, line end, text, <|im_end|>, line end.
START, END = "<|im_start|>", "<|im_end|>\n"
_TURN = r"<\|im_start\|>([^\n]*)\n((?s:.*?))<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """One more backslash into each ``<``, backslashes, ``|``: so no text holds ``<|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles are one line: backslashes double, line ends are ``\\n``, and control strings as in texts."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # a doubled backslash waits as \x00 (doubled itself as \x00\x01) while \n is replaced
    held = F.replace(F.replace(unescape(role), F.lit("\0"), F.lit("\0\1")), F.lit("\\\\"), F.lit("\0\2"))
    lines = F.replace(held, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(lines, F.lit("\0\2"), F.lit("\\")), F.lit("\0\1"), F.lit("\0"))


def render(turns: Column) -> Column:
    """Formatted text of an array of (role, text) as they stand."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped: the deterministic parser."""
    roles = F.regexp_extract_all(formatted, F.lit(_TURN), 1)
    texts = F.regexp_extract_all(formatted, F.lit(_TURN), 2)
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape_role(r).alias("role"), unescape(t).alias("text")))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask, escaped, identical) for each conversation.

    Turns are ordered by turn, then role and text, so ties have one order;
    repeated rows are repeated turns.  Null roles and texts are empty, a null
    turn comes first, a null conversation id is a conversation.  A conversation
    is rendered as it stands and reparsed; where the recovered turns differ from
    the source, it is rendered with control strings escaped (``escaped``), which
    parses back to the source whatever it holds (``identical``).

    ``loss_mask`` holds, turn by turn, the code points before the turn's text,
    those of the text and those after it, and whether the text is learnt: that
    of the role ``learn`` is.  A conversation is one row, as its text is one.
    """
    turns = rows.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("source"))
    found = found.withColumn("source", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    plain = render(F.col("source"))
    safe = F.transform("source", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    found = found.withColumn("plain", plain).withColumn("escaped", parse(F.col("plain")) != F.col("source"))
    found = found.withColumn("shown", F.when(F.col("escaped"), safe).otherwise(F.col("source")))
    found = found.withColumn("formatted", F.when(F.col("escaped"), render(F.col("shown"))).otherwise(F.col("plain")))
    mask = F.zip_with("shown", "source", lambda t, s: F.struct(
        (F.length(t["role"]) + len(START) + 1).alias("before"), F.length(t["text"]).alias("text"),
        F.lit(len(END)).alias("after"), (s["role"] == learn).alias("learnt")))
    return found.select("conv_id", "formatted", mask.alias("loss_mask"), "escaped",
                        (parse(F.col("formatted")) == F.col("source")).alias("identical"))


def learnt_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, unescaped, in order: read from the formatted text's segments."""
    texts = F.regexp_extract_all(formatted, F.lit(_TURN), 2)
    return F.array_join(F.zip_with(texts, loss_mask, lambda t, m: F.when(m["learnt"], unescape(
        F.substring(t, F.lit(1), m["text"]))).otherwise(F.lit(""))), "")
