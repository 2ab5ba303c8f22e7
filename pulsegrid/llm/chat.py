"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and sorted by sequence; streamed deltas, edits and
regenerations fold into final messages, which are then rendered with a reversible escape. All steps are
DataFrame expressions.

Events have conv_id, seq, msg (the message's place in its conversation), kind, role and text. Kinds:
`message` (a whole message), `delta` (text to append), `edit` (replaces the text so far), `regenerate`
(drops the text so far and all later messages that had begun before it; deltas follow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template. A turn is OPEN, the role, MIDDLE, the text, CLOSE, with role and text escaped.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: What escape() writes for each character that a control string has; the backslash itself comes first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """No control string remains: every backslash, <, # and : becomes a backslash and a letter."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The inverse of escape: an escaped text has a backslash only before one of the letters, so the order is free but for the backslash, last."""
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as events: each row one message, in order of turn (null first); rows of one turn by role and text, each its own message."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return conversations.select("conv_id", at.alias("seq"), at.alias("msg"), F.lit("message").alias("kind"), "role", "text")


def as_log(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as the log of a chat client that streamed, edited and regenerated them; folding it gives the turns back.

    Each turn's text comes in up to three deltas, cut at places that a hash of the text chooses. Before that, by
    the same hash: an eighth of the turns had a draft that was streamed and then regenerated, an eighth one
    that a later edit to the first piece replaced, and an eighth are whole messages. Order, ties, nulls and
    repeated rows are those of as_events.
    """
    turns = as_events(conversations).select("conv_id", "msg", "role", F.coalesce("text", F.lit("")).alias("text"))
    size, way = F.char_length("text"), F.pmod(F.xxhash64("text", "msg"), F.lit(8))
    cut = lambda seed: F.pmod(F.xxhash64("text", "msg", F.lit(seed)), size + 1).cast("int")
    turns = turns.withColumns({"way": way, "x": F.least(cut(1), cut(2)), "y": F.greatest(cut(1), cut(2))})
    event = lambda kind, text, role=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))
    piece = lambda a, b: F.substring("text", a + 1, b - a)
    said, zero, role = F.lit("as first said: "), F.lit(0), F.col("role")
    first, second, third = piece(zero, F.col("x")), piece(F.col("x"), F.col("y")), piece(F.col("y"), size)
    rest = [event("delta", second), event("delta", third)]
    log = (
        F.when(F.col("way") == 0, F.array(event("delta", F.concat(said, first), role), event("delta", second), event("regenerate", F.lit(None).cast("string")), event("delta", first), *rest))
        .when(F.col("way") == 1, F.array(event("message", F.concat(said, third), role), event("edit", first), *rest))
        .when(F.col("way") == 2, F.array(event("message", F.col("text"), role)))
        .otherwise(F.array(event("delta", first, role), *rest))
    )
    events = turns.select("conv_id", "msg", F.posexplode(log).alias("at", "e"))
    return events.select("conv_id", (F.col("msg") * 8 + F.col("at")).alias("seq"), "msg", "e.kind", "e.role", "e.text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold events into final messages: conv_id, msg, role, text.

    A null text counts as empty, a null role as empty. Events of one seq fold in order of kind and text.
    Messages of a null conversation form one conversation. A message's role is that of its first event that
    has one. Repeated delta rows count each: the log is taken as it is. One shuffle, by conversation: both
    groupings and the window below share it.
    """
    e = events.select("conv_id", "seq", "msg", "kind", F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    # from the last event backwards: a frame that only grows takes one pass
    later = Window.partitionBy("conv_id").orderBy(F.col("seq").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # a regeneration of message m takes away what came before it for messages after m
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("msg"))).over(later)
    e = e.withColumn("cut", cut).where(F.col("cut").isNull() | F.col("msg").isNull() | (F.col("msg") <= F.col("cut")))
    grouped = e.groupBy("conv_id", "msg").agg(
        F.max(F.when(F.col("kind") != "delta", F.col("seq"))).alias("reset"),
        F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role"))).alias("log"),
    )
    kept = F.filter("log", lambda x: F.coalesce(x["seq"] >= F.col("reset"), F.lit(True)))
    roles = F.filter("log", lambda x: x["role"].isNotNull())
    return grouped.select("conv_id", "msg", F.coalesce(F.get(roles, F.lit(0))["role"], F.lit("")).alias("role"), F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Render each conversation: conv_id, formatted (string), loss_mask (array of structs start and length, in code points of formatted: the escaped text of each assistant message)."""
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", F.struct("role", "text").alias("m")))).alias("t"))
    turns = turns.select("conv_id", F.transform("t", lambda x: F.struct(x["m"]["role"].alias("role"), F.concat(F.lit(OPEN), escape(x["m"]["role"]), F.lit(MIDDLE)).alias("head"), escape(x["m"]["text"]).alias("body"))).alias("t"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask"))

    def step(a: Column, x: Column) -> Column:
        head, body = F.char_length(x["head"]).cast("long"), F.char_length(x["body"]).cast("long")
        here = F.array(F.struct((a["at"] + head).alias("start"), body.alias("length")))
        return F.struct((a["at"] + head + body + F.lit(len(CLOSE))).alias("at"), F.when(x["role"] == ASSISTANT, F.concat(a["mask"], here)).otherwise(a["mask"]).alias("mask"))

    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"), F.aggregate("t", begin, step)["mask"].alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse rendered conversations: conv_id, turns (array of structs role and text), loss_text (all text under the mask, unescaped, nothing between)."""
    parts = F.filter(F.split(F.col("formatted"), CLOSE), lambda x: x != "")

    def turn(x: Column) -> Column:
        at = F.instr(x, MIDDLE)
        return F.struct(unescape(F.substring(x, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substring(x, at + F.lit(len(MIDDLE)), F.lit(2**31 - 1))).alias("text"))

    under = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return rendered.select("conv_id", F.transform(parts, turn).alias("turns"), F.array_join(under, "").alias("loss_text"), "formatted", "loss_mask")


def digests(parsed: DataFrame) -> DataFrame:
    """Counts and digests of what read_back gives."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
