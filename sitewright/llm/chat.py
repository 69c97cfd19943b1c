"""Chat formatting by prefix-target expansion, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: OPEN role MIDDLE text CLOSE for each turn.
OPEN, MIDDLE, CLOSE = "<turn:", ">", "</turn>\n"


def escape(text: Column) -> Column:
    """Puts one more backslash between "<" or "</" and "turn", so that no control string is left in a text."""
    return F.regexp_replace(text, r"<(/?)(\\*)turn", r"<$1$2\\turn")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, r"<(/?)(\\*)\\turn", "<$1$2turn")


def escape_role(role: Column) -> Column:
    """escape() for a role, which must not hold MIDDLE either."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(">"), F.lit("%3E")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%3E"), F.lit(">")), F.lit("%25"), F.lit("%"))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: F.startswith(p, F.lit(OPEN)))

    def turn(piece: Column) -> Column:
        at = F.locate(MIDDLE, piece) if isinstance(piece, str) else F.instr(piece, MIDDLE)
        return F.struct(
            unescape_role(F.substring(piece, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substring(piece, at + F.lit(1), F.length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def expand_chats(turns: DataFrame) -> DataFrame:
    """One example for each assistant turn: all turns up to it are context and its text alone is trainable.

    turns: conv_id, turn, role, text (more columns are not used, whatever their names). Returns conv_id, example (from
    0), n_turns, text, loss_start and loss_length (code points of text; from 0; the reply's escaped text), is_last.
    Turns after the last assistant turn, which no reply has as context, make a last example of all turns with an empty
    loss span, so that the output holds every turn.

    Null text and null role count as empty. Rows without conv_id belong to no conversation and are left out. Rows of
    one conversation are ordered by turn (null first), then role, then text; repeated rows stay as turns of their own.
    An empty table gives an empty table. A role counts as assistant's when it is "assistant" exactly.

    A conversation is gathered once, in linear size; each example's text is made as its row is handed on, so memory
    holds one example at a time though all examples of a conversation are quadratic in its length.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    chats = chats.select(
        "conv_id",
        F.transform("t", lambda x: format_turn(x["role"], x["text"])).alias("parts"),
        F.transform("t", lambda x: x["role"] == F.lit("assistant")).alias("replies"),
        F.transform("t", lambda x: F.length(escape_role(x["role"])) + F.lit(len(OPEN + MIDDLE))).alias("heads"),
    )
    chats = chats.withColumn("ends", F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("replies", i) | (i == F.size("parts"))))
    one = chats.select("conv_id", "parts", "replies", "heads", F.posexplode("ends").alias("example", "end"), F.size("ends").alias("n"))
    reply = F.element_at("replies", F.col("end"))
    made = one.select(
        "conv_id",
        "example",
        F.col("end").cast("long").alias("n_turns"),
        F.array_join(F.slice("parts", F.lit(1), F.col("end")), "").alias("text"),
        F.length(F.element_at("parts", F.col("end"))).alias("last"),
        F.element_at("heads", F.col("end")).alias("head"),
        reply.alias("reply"),
        (F.col("example") + 1 == F.col("n")).alias("is_last"),
    )
    return made.select(
        "conv_id",
        "example",
        "n_turns",
        "text",
        F.when(F.col("reply"), F.length("text") - F.col("last") + F.col("head")).otherwise(F.length("text")).cast("long").alias("loss_start"),
        F.when(F.col("reply"), F.col("last") - F.col("head") - F.lit(len(CLOSE))).otherwise(F.lit(0)).cast("long").alias("loss_length"),
        "is_last",
    )


def loss_text(examples: DataFrame) -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescape(F.substring(examples["text"], (examples["loss_start"] + 1).cast("int"), examples["loss_length"].cast("int")))


def chat_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: all turns from the last one, each reply from its own."""
    turns = F.array_join(F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id",
        F.when(F.col("is_last"), F.size(read_turns(F.col("text"))).cast("long")).alias("n_turns"),
        F.when(F.col("is_last"), F.sha2(turns.cast("binary"), 256)).alias("turns_sha256"),
        F.struct("example", loss_text(examples).alias("said")).alias("said"),
        F.length("text").cast("long").alias("chars"),
    )
    found = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("said")), lambda x: x["said"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return found.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
