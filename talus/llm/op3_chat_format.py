"""Chat formatting from event logs, with DataFrame functions only.

A log holds events (conv_id, message key columns, seq, kind, role, text). Events of one message are sorted by seq and folded:
``message``, ``edit`` and ``regenerate`` replace what the message said so far, ``delta`` appends to it; the last role that is
given counts. Logs are parted by conversation and, so that the events of one huge conversation are spread over tasks, by
message; only finished messages are gathered by conversation, whose text is one row in any case. Messages are sorted by their
key columns, nulls first. ``stream`` makes such a log of finished messages, as a chat service would have written it.

The template marks turns: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a line feed. In texts every ``<``,
backslashes, ``|`` gets one backslash more, so no control string is left in them and the step can be undone. In roles ``%``,
``<`` and line feeds are written as ``%25``, ``%3C`` and ``%0A``. Null texts and roles are empty. The loss mask is a flag on
the segments of the formatted text: it holds for the texts of assistant turns. Events equal in all columns fold like others:
for full messages that changes nothing. Conversations without events don't appear; a null conv_id is a conversation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def fold(events: DataFrame, message: Sequence[str] = ("turn",)) -> DataFrame:
    """Final messages: conv_id, the key columns, role and text."""
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", *message).agg(F.sort_array(F.collect_list(event)).alias("_log"))
    numbered = F.transform("_log", lambda e, k: F.when(F.coalesce(e["kind"], F.lit("message")) != "delta", k))
    since = F.coalesce(F.array_max(numbered), F.lit(0))
    said = F.slice("_log", since + 1, F.size("_log"))
    roles = F.filter(F.transform("_log", lambda e: e["role"]), lambda r: r.isNotNull())
    return logs.select(
        "conv_id",
        *message,
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"),
    )


def stream(messages: DataFrame, message: Sequence[str] = ("turn",), loss_role: str = "assistant", pieces: int = 4) -> DataFrame:
    """A log that folds to messages (conv_id, key columns, role, text), its events out of order. Answers begin with a delta of
    a draft, are regenerated, and then come in so many deltas; other messages are sent as a draft, go on with a delta, and are
    edited to what they say."""
    text = F.coalesce("text", F.lit(""))
    draft = F.concat(F.substring(text, 1, 20), F.lit(" …"))
    none = F.lit(None).cast("string")
    event = lambda seq, kind, role, said: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), said.alias("text"))
    size = F.ceil(F.length(text) / pieces)
    parts = [event(2 + k, "delta", none, F.substr(text, size * k + 1, size)) for k in range(pieces)]
    answer = F.array(*reversed([event(0, "delta", F.col("role"), draft), event(1, "regenerate", none, none), *parts]))
    other = F.array(event(2, "edit", F.col("role"), text), event(1, "delta", none, draft), event(0, "message", none, draft))
    return messages.select("conv_id", *message, F.explode(F.when(F.col("role") == loss_role, answer).otherwise(other)).alias("_e")).select("conv_id", *message, "_e.*")


def render(messages: DataFrame, message: Sequence[str] = ("turn",), loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and segments: pieces of formatted in order, with loss where the mask holds."""
    turn = F.struct(*message, F.col("role"), escape(F.col("text")).alias("body"))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.array(
                piece(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")), F.lit(False)),
                piece(t["body"], t["role"] == loss_role),
                piece(F.lit(END + "\n"), F.lit(False)),
            ),
        )
    )
    out = turns.select("conv_id", parts.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text says."""
    chunks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda c: F.length(c) > 0)
    role = lambda c: F.substring_index(c, "\n", 1)
    body = lambda c: F.substr(c, F.length(role(c)) + 2, F.length(c) - F.length(role(c)) - 2 - len(END))
    return F.transform(chunks, lambda c: F.struct(_unescape_role(role(c)).alias("role"), unescape(body(c)).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(rendered: DataFrame) -> DataFrame:
    """What the rendered conversations say when they are read back."""
    turns, loss = F.col("_turns"), F.col("_loss")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = rendered.select("conv_id", parse(F.col("formatted")).alias("_turns"), loss_text(F.col("segments")).alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
