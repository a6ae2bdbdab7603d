"""Chats from logs of events: final messages of each conversation, and one training text with a loss mask.

An event belongs to a conversation and to a numbered message of it, and has a sequence number:

* ``message`` opens a message with a text (two events that open the same number are two messages, in order);
* ``delta`` appends to the message, as streaming does;
* ``edit`` replaces the text so far;
* ``regenerate`` replaces it as well and also drops what later messages had received before.

An event with another kind, or none, counts as a delta. Order is by message number, then sequence, then the event's
other fields, so ties and repeated rows have one outcome. Null texts, roles and numbers: empty text, empty role, and
first in order. A null conversation id is a conversation of its own. Other columns are ignored.

Events are folded in blocks of message numbers, so a conversation with a third of all rows is spread over many tasks;
only its finished blocks meet in the row of its result. Texts of one conversation must fit in one value (2 GB).

The template writes ``### role: text</turn>`` and a line end for each message. Inside texts and roles the backslash,
``<`` and ``#`` (in roles also ``:``) are written as ``\\\\``, ``\\l``, ``\\h`` and ``\\c``, so no control string can occur
in them and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, SEPARATOR, TAIL = "### ", ": ", "</turn>\n"
#: Message numbers folded together.
BLOCK = 512
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """Inverse of ``escape``. Every backslash begins a pair, so cutting at double ones from the left is exact."""
    pieces = F.split(text, r"\\\\", -1)

    def plain(piece: Column) -> Column:
        for safe, char in (("\\l", "<"), ("\\h", "#"), ("\\c", ":")):
            piece = F.replace(piece, F.lit(safe), F.lit(char))
        return piece

    return F.array_join(F.transform(pieces, plain), "\\")


def final_messages(events: DataFrame) -> DataFrame:
    """Per conversation and block, the messages that remain: (conv_id, block, turns array of role and text)."""
    rows = events.select(
        "conv_id",
        F.coalesce(F.col("message").cast("long"), F.lit(-(1 << 62))).alias("message"),
        F.col("seq").cast("long").alias("seq"),
        F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # A struct equals itself when its fields are null, so one key serves the join and the grouping.
    place = F.struct("conv_id", F.floor(F.col("message") / BLOCK).alias("block"))
    rows = _without_regenerated(rows.withColumn("place", place))
    event = F.struct("message", "seq", "kind", "role", "text")
    blocks = rows.groupBy("place").agg(F.array_sort(F.collect_list(event)).alias("events"))
    return blocks.select("place.conv_id", "place.block", _fold(F.col("events")).alias("turns"))


def _without_regenerated(rows: DataFrame) -> DataFrame:
    """Rows that no later regeneration of the same or an earlier message has dropped.

    A row meets the last regeneration of the blocks before its own, a running maximum over one row per block, and the
    last one of each message of its own block, at most ``BLOCK``. Rows meet them by conversation and block, so a hot
    conversation is spread however often it was regenerated.
    """
    redone = rows.filter(F.col("kind") == "regenerate").groupBy("place", "message").agg(F.max("seq").alias("seq"))
    marks = redone.groupBy("place").agg(
        F.max("seq").alias("last"), F.array_sort(F.collect_list(F.struct("message", "seq"))).alias("marks")
    )
    blocks = rows.select("place").distinct().join(marks, "place", "left")
    earlier = Window.partitionBy("place.conv_id").orderBy("place.block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.max("last").over(earlier)).filter("before is not null or marks is not null")
    joined = rows.join(blocks.select("place", "before", "marks"), "place", "left")
    own = F.coalesce("seq", F.lit(-(1 << 62)))
    dropped = F.exists("marks", lambda r: (r["message"] <= F.col("message")) & (r["seq"] > own))
    earlier_drops = F.coalesce(F.col("before") > own, F.lit(False))
    return joined.filter(~earlier_drops & ~F.coalesce(dropped, F.lit(False))).drop("before", "marks")


def _fold(events: Column) -> Column:
    """Messages of a sorted block of events."""
    numbers = F.sequence(F.lit(1), F.size(events))
    opens = F.filter(
        numbers,
        lambda i: (i == 1)
        | (F.element_at(events, i)["kind"] == "message")
        | (F.element_at(events, i)["message"] != F.element_at(events, F.greatest(i - 1, F.lit(1)))["message"]),
    )
    stops = F.concat(F.slice(opens, 2, F.size(opens)), F.array(F.size(events) + 1))
    own = F.zip_with(opens, stops, lambda start, stop: F.slice(events, start, stop - start))
    return F.transform(own, _fold_message)


def _fold_message(events: Column) -> Column:
    resets = F.transform(events, lambda e, i: F.when(e["kind"].isin("message", "edit", "regenerate"), i + 1).otherwise(1))
    kept = F.slice(events, F.array_max(resets), F.size(events))
    roles = F.filter(F.transform(events, lambda e: e["role"]), lambda r: r != "")
    return F.struct(
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learnt_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted``, and ``loss``, for each turn the start and length, counted in code
    points from the turn's beginning, of the text to learn (length 0: nothing)."""

    def head(turn: Column) -> Column:
        role = F.replace(escape(turn["role"]), F.lit(":"), F.lit("\\c"))
        return F.concat(F.lit(HEAD), role, F.lit(SEPARATOR))

    parts = messages.select(
        "conv_id",
        "block",
        F.array_join(
            F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(TAIL))), ""
        ).alias("formatted"),
        F.transform(
            "turns",
            lambda t: F.struct(
                F.char_length(head(t)).alias("start"),
                F.when(t["role"] == learnt_role, F.char_length(escape(t["text"]))).otherwise(0).alias("length"),
            ),
        ).alias("loss"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "formatted", "loss"))).alias("parts")
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("parts", lambda p: p["loss"])).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a rendered text: array of role and text."""
    parts = F.split(formatted, TAIL, -1)
    pattern = f"(?s)^{HEAD}([^:]*){SEPARATOR}(.*)$"
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, pattern, 1)).alias("role"),
            unescape(F.regexp_extract(p, pattern, 2)).alias("text"),
        ),
    )


def masked_texts(formatted: Column, loss: Column) -> Column:
    """Array of the texts under the loss mask, unescaped."""
    parts = F.split(formatted, TAIL, -1)
    spans = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), loss, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    learnt = F.filter(spans, lambda s: s["m"]["length"] > 0)
    return F.transform(learnt, lambda s: unescape(F.substring(s["p"], s["m"]["start"] + 1, s["m"]["length"])))


def message_events(conversations: DataFrame, turn: str = "turn") -> DataFrame:
    """A log of finished turns as events: each row opens a message of its own."""
    return conversations.select(
        "conv_id",
        F.col(turn).alias("message"),
        F.col(turn).alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )
