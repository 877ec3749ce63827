r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted by turn, and adjacent turns of
one role are merged into one block. The template is

    <|im_start|>role\ntext<|im_sep|>text<|im_end|>\n

where ``<|im_sep|>`` separates merged turns, so that the turns can be read back. Control
strings inside roles and texts are escaped reversibly: every ``<\...\|`` with k >= 0
backslashes gets one more, so no escaped text holds ``<|``, and unescaping takes one away.

Defined cases: null texts and roles are empty; turns without a number come first; ties of a
turn are ordered by role and text; repeated rows are repeated turns; a null conv_id is one
conversation; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Takes the control meaning from a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def head(role: Column) -> Column:
    """A role as one escaped line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unhead(line: Column) -> Column:
    """The inverse of ``head``."""
    return F.replace(F.replace(unescape(line), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: array of (start, length) in code points, from 0.

    The spans cover the escaped texts of ``loss_role``, without any marker."""
    t = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
        ).alias("t"),
    )
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(turns: Column) -> Column:
        # Array aggregation: a turn opens a block unless the one before has its role.
        def piece(x: Column, i: Column) -> Column:
            opens = (i == 0) | (x["role"] != F.get(turns, i - 1)["role"])
            close = F.when(i > 0, F.lit(f"{END}\n")).otherwise(F.lit(""))
            mark = F.when(opens, F.concat(close, F.lit(START), head(x["role"]), F.lit("\n"))).otherwise(F.lit(SEP))
            return F.struct(mark.alias("before"), escape(x["text"]).alias("text"), (x["role"] == F.lit(loss_role)).alias("loss"))

        return F.transform(turns, piece)

    g = g.select("conv_id", let(F.col("turns"), pieces).alias("pieces"))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(f"{END}\n"))
    g = g.withColumn("sizes", F.transform("pieces", lambda p: F.struct(F.length(p["before"]).alias("b"), F.length(p["text"]).alias("n"), p["loss"].alias("loss"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, s: F.struct(
        (a["at"] + s["b"] + s["n"]).alias("at"),
        F.when(s["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + s["b"]).alias("start"), s["n"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    return g.select("conv_id", formatted.alias("formatted"), F.aggregate("sizes", zero, step)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, r"(?:^|<\|im_end\|>\n)<\|im_start\|>|<\|im_end\|>\n\z"), lambda b: b != "")
    role = lambda b: unhead(F.substring_index(b, "\n", 1))
    texts = lambda b: F.split(F.substr(b, F.instr(b, "\n") + 1), r"<\|im_sep\|>")
    return F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda x: F.struct(role(b).alias("role"), unescape(x).alias("text")))))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))


def chat_digest(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    f = format_chats(turns)
    f = f.withColumn("read", read_back(F.col("formatted"))).withColumn("loss", F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(F.encode(said, "utf-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode(F.col("loss"), "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
