"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line break. The rendered text is parsed
again by a deterministic parser; where the recovered turns differ from the source, or a role or text holds a
control string of a common chat grammar, the conversation is rendered anew with its control strings
escaped, and parsed once more; a conversation that still differs is an error. Escaping puts one more backslash
after the first character of a control string, unescaping takes one away, so it is reversible at any depth and
leaves ordinary text alone.

The loss mask is run-length encoded, one entry per turn: characters before, inside and after the part that
counts (the text of assistant turns).

Defined cases: null roles and texts count as empty; equal turn numbers are ordered by role and text; null turns come
first; a null conversation id is one conversation. A conversation is one row of the result, so its turns meet in one
task whatever the plan.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# What may follow the first character of a control string of common chat grammars.
REST = r"/?s>|/?INST\]|</?SYS>>|\|(?:im_start|im_sep|im_end|endoftext|begin_of_text|eot_id)\|>"
CONTROL = rf"([<\[])(\\*)({REST})"
ESCAPED = rf"([<\[])\\(\\*)({REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(
        turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END))), "")


def segments(formatted: Column) -> Column:
    """The rendered turns, without their end marks."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped."""
    def turn(segment: Column) -> Column:
        head = F.substring_index(segment, SEP, 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(segment, F.length(head) + F.lit(len(SEP) + 1))).alias("text"))

    return F.transform(segments(formatted), turn)


def _mask(formatted: Column) -> Column:
    def runs(segment: Column) -> Column:
        head = F.length(F.substring_index(segment, SEP, 1)) + F.lit(len(SEP))
        counts = segment.startswith(START + "assistant" + SEP)
        return F.struct(
            F.when(counts, head).otherwise(F.length(segment)).alias("before"),
            F.when(counts, F.length(segment) - head).otherwise(0).alias("inside"),
            F.lit(len(END)).alias("after"))

    return F.transform(segments(formatted), runs)


def format_chats(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, mask, n_turns and escaped."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    chats = chats.withColumn("turns", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"))))
    chats = chats.withColumn("plain", _render(F.col("turns")))
    holds = F.exists("turns", lambda t: F.regexp_like(F.concat(t["role"], F.lit(" "), t["text"]), F.lit(CONTROL)))
    chats = chats.withColumn("escaped", holds | (parse(F.col("plain")) != F.col("turns")))
    safe = _render(F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"),
                                                           escape(t["text"]).alias("text"))))
    chats = chats.withColumn("formatted", F.when(F.col("escaped"), safe).otherwise(F.col("plain")))
    same = ~F.col("escaped") | (parse(F.col("formatted")) == F.col("turns"))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
    return chats.select("conv_id", checked.alias("formatted"), F.size("turns").alias("n_turns"), "escaped").select(
        "conv_id", "formatted", _mask(F.col("formatted")).alias("mask"), "n_turns", "escaped")


def digests(chats: DataFrame) -> DataFrame:
    """Read back from the formatted text and its mask: turns and loss digests."""
    turns = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.zip_with(segments(F.col("formatted")), F.col("mask"), lambda s, m: unescape(
        F.substr(s, m["before"] + F.lit(1), m["inside"]))), "")
    return chats.select(
        "conv_id", F.size(segments(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
