"""Event-sourced chat formatting, in DataFrame functions only.

A log holds events (conversation, sequence, message, kind, role, text). By message, in order of sequence:
``delta`` appends its text, ``edit`` replaces all text so far by its own, ``regenerate`` discards the text so far.
Other kinds change nothing. A message stands where its first event stands; its role is the first that is given.

Template: ``<turn ROLE>\\n`` TEXT ``\\n</turn>\\n`` for each message. Inside texts and roles ``\\`` becomes ``\\b`` and ``<`` becomes
``\\l`` (in roles also ``>`` ``\\g`` and newline ``\\n``), so that neither marks nor escapes can be forged, and unescaping is
exact: after escaping each backslash is followed by its code letter. The loss mask is the spans (start, length, in
code points of the output) of assistant texts.

Plan: one shuffle folds messages, one brings a conversation's messages together in order; a conversation is one
output row, so its size bounds a task's memory, while deltas are folded before that by message.

Defined results: a null text is empty, a null role is ''; null conversation ids form one conversation; a null
sequence comes first; equal events count each. An empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TAIL = "\n</turn>\n"
ASSISTANT = "assistant"
# Piece of a text that one delta carries when a finished text is turned into events.
PIECE = 2000


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


_TEXT = [("\\", "\\b"), ("<", "\\l")]
_ROLE = [*_TEXT, (">", "\\g"), ("\n", "\\n")]


def escape(text: Column, role: bool = False) -> Column:
    return _swap(text, _ROLE if role else _TEXT)


def unescape(text: Column, role: bool = False) -> Column:
    return _swap(text, [(b, a) for a, b in reversed(_ROLE if role else _TEXT)])


def as_events(rows: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> DataFrame:
    """Finished rows as a log: each row is a message of its own, streamed in deltas of up to ``piece`` characters."""
    kept = F.coalesce(F.col(text), F.lit(""))
    numbered = rows.select(
        F.col(conversation).alias("conversation"),
        F.row_number().over(W.partitionBy(conversation).orderBy(order, role, text)).cast("long").alias("message"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        kept.alias("whole"),
    )
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.char_length("whole") - 1) / piece), F.lit(0)).cast("int"))
    events = numbered.select("conversation", "message", "role", "whole", F.explode(starts).alias("no"))
    sequence = F.col("message") * F.lit(1 << 32) + F.col("no")
    return events.select("conversation", sequence.alias("sequence"), "message", F.lit("delta").alias("kind"), "role", F.substring(F.col("whole"), F.col("no") * piece + 1, F.lit(piece)).alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """(conversation, at, message, role, text): the final messages of a log.

    Events of one message with one sequence are taken by kind, then text, then role, so any order of rows gives one result."""
    told = F.struct(F.col("sequence").alias("s"), F.col("kind").alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("t"), F.col("role").alias("r"))
    grouped = events.groupBy("conversation", "message").agg(F.sort_array(F.collect_list(told)).alias("log"))
    reset = F.array_max(F.transform("log", lambda e, i: F.when(e["k"].isin("edit", "regenerate"), i + 1).otherwise(1)))
    grouped = grouped.withColumn("from", reset)
    live = F.filter(F.slice("log", F.col("from"), F.size("log")), lambda e: e["k"].isin("delta", "edit"))
    return grouped.select(
        "conversation",
        F.col("log")[0]["s"].alias("at"),
        "message",
        F.coalesce(F.get(F.filter(F.transform("log", lambda e: e["r"]), lambda r: r.isNotNull()), F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["t"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conversation, formatted, loss): loss is array<struct<start, length>> over the formatted text, from 0."""
    head = F.concat(F.lit("<turn "), escape(F.col("role"), True), F.lit(">\n"))
    parts = messages.select("conversation", "at", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    ordered = W.partitionBy("conversation").orderBy("at", "message")
    size = (F.char_length("head") + F.char_length("body") + len(TAIL)).cast("long")
    before = F.sum(size).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)) - size
    placed = parts.withColumn("start", before + F.char_length("head"))
    row = F.struct("start", F.concat("head", "body", F.lit(TAIL)).alias("piece"), F.char_length("body").cast("long").alias("length"), (F.col("role") == ASSISTANT).alias("mine"))
    whole = placed.groupBy("conversation").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: r["mine"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length")))
    return whole.select("conversation", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), spans.alias("loss"))


def format_log(events: DataFrame) -> DataFrame:
    """Folds a log and renders its conversations."""
    return render(fold(events))


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds turns (array<struct<role, text>>) and loss_text, both parsed from ``formatted`` and ``loss``."""
    raw = F.filter(F.split("formatted", TAIL), lambda x: x != "")
    head = lambda x: F.substring_index(x, ">\n", 1)
    turns = F.transform(
        raw,
        lambda x: F.struct(
            unescape(F.substring(head(x), F.lit(len("<turn ") + 1), F.char_length(x)), True).alias("role"),
            unescape(F.substring(x, F.char_length(head(x)) + 3, F.char_length(x))).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return rendered.withColumns({"turns": turns, "loss_text": F.array_join(masked, "")})
