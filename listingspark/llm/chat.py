"""Chat formatting with a grammar round trip.

conversation := turn*
turn         := START role NEWLINE text END NEWLINE

A turn is rendered as it is, read back by the parser, and compared with its source. Content that does not come back
identical is escaped and tried again. The parser always unescapes, so that it needs no flag: in the escaped form each
run of bars after ``<`` has one bar more, and START and END are the only places where ``<`` meets a single bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """One bar more after each ``<`` that bars follow."""
    return F.regexp_replace(text, r"<(\|+)", "<|$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", "<$1")


def escape_role(role: Column) -> Column:
    """A role ends with its line, so line ends in it are written as two characters."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    out = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.replace(out, F.lit("\\\\"), F.lit("\\")))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, by the grammar above."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.size(F.split(formatted, r"<\|im_start\|>")))
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.regexp_extract(x, r"(?s)^[^\n]*\n(.*?)<\|im_end\|>", 1)).alias("text"),
        ),
    )


def format_chats(turns: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """Formatted conversations of turns(conv_id, turn, role, text).

    Returns conv_id, formatted, parsed (turns read back: array<struct<role, text>>) and loss (text under the loss
    mask: what turns of ``loss_role`` say, unescaped, in order), round_trip (the turns read back equal the source; a
    conversation of which they don't ends the job, so it is always true).
    Turns are ordered by turn, ties by role, then text, null turns first. Null role or text: empty. Null conv_id: a
    conversation of its own. Repeated rows are turns of their own. Empty input: empty result. Other columns are
    ignored. A conversation is one row of the result, so its turns meet in one task; conversations spread evenly."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    df = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # first as they are; then, for what the parser doesn't give back, escaped
    back = F.get(parse(render_turn(F.col("role"), F.col("text"))), F.lit(0))
    alone = F.size(parse(render_turn(F.col("role"), F.col("text")))) == 1
    risky = F.contains(F.col("text"), F.lit("<|")) | F.contains(F.col("role"), F.lit("<|")) | F.contains(F.col("role"), F.lit("\n")) | F.contains(F.col("role"), F.lit("\\")) | F.endswith(F.col("text"), F.lit("<"))
    same = F.when(risky, alone & (back["role"] == F.col("role")) & (back["text"] == F.col("text"))).otherwise(F.lit(True))
    df = df.withColumn("same", F.coalesce(same, F.lit(False)))
    df = df.select(
        "conv_id",
        F.struct("turn", "role", "text", F.when(F.col("same"), F.col("role")).otherwise(escape_role(F.col("role"))).alias("role_out"), F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))).alias("text_out")).alias("t"),
    )
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    df = df.withColumn("formatted", F.array_join(F.transform("turns", lambda t: render_turn(t["role_out"], t["text_out"])), ""))
    df = df.withColumn("parsed", parse(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    same = source == F.col("parsed")
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("not read back as it was: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return df.select("conv_id", checked.alias("formatted"), "parsed", loss.alias("loss"), same.alias("round_trip"))


def chat_digest(chats: DataFrame) -> DataFrame:
    """The digest columns of a formatted table, from what was read back."""
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
