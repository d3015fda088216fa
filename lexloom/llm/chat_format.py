"""Chat logs to training texts: event-sourced reconstruction, a template with reversible escapes, and a loss mask.

A log is a table of events: conversation, sequence number, kind, message, role and text.  Kinds are ``message`` (starts
a message), ``delta`` (appends streamed text), ``edit`` (replaces what there is so far) and ``regenerate`` (discards it).
The log is partitioned by conversation once; within it the events of each message are sorted by sequence number and
folded: what stands after the last edit or regeneration counts.  Messages then follow each other by the sequence number
they began with.  Everything is built of DataFrame functions.

The template marks turns with ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed.  Texts and
roles can hold anything: a backslash becomes ``\\b`` and ``<|`` becomes ``<\\p``, in roles a line feed ``\\n``, so no text
ever shows a marker, and reading back gives the very same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\p"), F.lit("|")), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _final(segment: Column) -> Column:
    """The text that a message's events, in order, leave: what follows the last edit or regeneration, itself included."""
    resets = F.filter(F.sequence(F.lit(1), F.size(segment)), lambda i: F.element_at(segment, i.cast("int"))["kind"].isin("edit", "regenerate"))
    last = F.coalesce(F.array_max(resets), F.lit(1))
    return F.array_join(F.transform(F.slice(segment, last.cast("int"), F.size(segment)), lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"])), "")


def reconstruct(events: DataFrame, *, conv_col: str = "conv_id", seq_col: str = "seq", kind_col: str = "kind", message_col: str = "message", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``: a row for each conversation with its final messages, ``array<struct<role, text>>``.

    Null text and role count as empty, a null kind as ``message``; an unknown kind does nothing.  A null sequence number comes first; ties
    are settled by kind (``message`` first), role and text, so any order of the rows gives the same result.  A second
    ``message`` event of one message starts another message (repeated rows stay); deltas, edits and regenerations go to
    the newest before them, and start a message of their own if there is none.  A null conversation or message id is an id like
    others.  An empty log gives an empty table; other columns are ignored.
    """
    kind = F.coalesce(F.col(kind_col), F.lit("message"))
    base = events.select(F.col(conv_col).alias("conv_id"), F.col(seq_col).alias("seq"), kind.alias("kind"), F.col(message_col).alias("message"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.where(F.col("kind").isin("message", "delta", "edit", "regenerate")).repartition("conv_id")
    order = F.when(F.col("kind") == "message", 0).otherwise(1)
    log = base.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(F.struct("seq", order.alias("order"), "kind", "role", "text"))).alias("log"))
    starts = F.filter(F.sequence(F.lit(1), F.size("log")), lambda i: F.element_at(F.col("log"), i.cast("int"))["kind"] == "message")
    starts = F.array_distinct(F.concat(F.array(F.lit(1)), starts))
    split = log.withColumn("starts", starts).select("conv_id", "log", "starts", F.posexplode("starts").alias("k", "start"))
    length = F.coalesce(F.get("starts", F.col("k") + 1), F.size("log") + 1) - F.col("start")
    messages = split.select("conv_id", F.slice("log", F.col("start").cast("int"), length.cast("int")).alias("segment"))
    messages = messages.select("conv_id", F.struct(F.col("segment")[0]["seq"].alias("seq"), F.col("segment")[0]["role"].alias("role"), _final(F.col("segment")).alias("text")).alias("m"))
    return messages.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("turns"))


def render(conversations: DataFrame, *, learn_from: str = ASSISTANT) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (code points [start, end) of each text by ``learn_from``) to (conv_id, turns)."""
    escaped = conversations.withColumn("__turns", F.transform("turns", lambda t: F.struct((t["role"] == learn_from).alias("learn"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"))))
    tail = f"{END}\n"
    formatted = F.array_join(F.transform("__turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    empty = F.lit(None).cast("array<struct<learn:boolean,start:int,end:int>>")
    begin = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<learn:boolean,start:int,end:int>>")).alias("spans"))
    step = lambda s, t: F.struct(
        (s["at"] + F.length(t["head"]) + F.length(t["body"]) + F.lit(len(tail))).alias("at"),
        F.concat(s["spans"], F.array(F.struct(t["learn"].alias("learn"), (s["at"] + F.length(t["head"])).alias("start"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end")))).alias("spans"),
    )
    spans = F.filter(F.aggregate("__turns", begin, step, lambda s: s["spans"]), lambda x: x["learn"])
    out = escaped.withColumn("formatted", formatted).withColumn("loss_spans", F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return out.drop("__turns")


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, learnt)`` from ``formatted`` and ``loss_spans`` alone: the turns, and the texts under the mask."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        body = F.substr(x, F.length(head) + 2, F.length(x) - F.length(head) - F.lit(len(END) + 2))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    learnt = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", F.transform(parts, turn).alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(formatted: DataFrame) -> DataFrame:
    """One row for each conversation: counts and hashes of what is read back from the output."""
    back = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as ``message`` events."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn").alias("message"), "role", "text")


def format_chats(events: DataFrame, **names: str) -> DataFrame:
    """``(conv_id, turns, formatted, loss_spans)`` of an event log; see ``reconstruct`` for odd rows."""
    return render(reconstruct(events, **names))
