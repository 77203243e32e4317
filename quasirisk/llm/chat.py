"""Chat formatting from event logs: fold deltas, edits and regenerations, then render.

Events are grouped by message first, so a conversation that holds a third of all rows is
folded and rendered in many tasks; only the rendered turns of a conversation meet at the
end, because the result is one string per conversation.  Built-in functions only.

Control strings all begin with "<|".  In texts a backslash is put behind every "<", so no
text can contain one, and dropping the character behind every "<" restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Events that start a message's text anew; "delta" adds to it.
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<\\"), F.lit("<"))


def fold_events(events: DataFrame) -> DataFrame:
    """Messages from rows (conv_id, message, seq, kind, role, text), any orderable ``message``.

    By seq, "message", "edit" and "regenerate" replace the text so far and "delta" adds to
    it; an unknown or NULL kind counts as "message".  The role is the last one that is not
    NULL.  Events with equal seq go by kind, role and text; equal rows count as often as
    they occur.  NULL keys form a conversation or message of their own.
    """
    kind = F.when(F.col("kind").isin("delta", *RESETS), F.col("kind")).otherwise(F.lit("message"))
    event = F.struct("seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    groups = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reset"))

    def last_reset(acc: Column, e: Column) -> Column:
        return F.struct((acc["n"] + 1).alias("n"), F.when(e["kind"] == "delta", acc["reset"]).otherwise(acc["n"]).alias("reset"))

    from_reset = F.aggregate("log", start, last_reset, lambda acc: acc["reset"])
    groups = groups.withColumn("from_", from_reset)
    parts = F.transform(F.slice("log", F.col("from_") + 1, F.size("log")), lambda e: e["text"])
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    role = F.coalesce(F.get(roles, F.size(roles) - 1), F.lit(""))
    return groups.select("conv_id", "message", role.alias("role"), F.array_join(parts, "").alias("text"))


def render(messages: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    ``formatted`` holds the turns by message; ``loss_spans`` gives, for each text of role
    ``learn_from``, the turn (from 0), the start inside that turn and the length, in code
    points of the formatted string.
    """
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    body = escape(F.col("text"))
    turn = F.struct(
        "message", F.concat(head, body, F.lit(END)).alias("block"), (F.col("role") == learn_from).alias("learn"),
        F.length(head).alias("start"), F.length(body).alias("length"),
    )
    whole = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"), t["learn"].alias("learn")))
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["turn"], s["start"], s["length"])).alias("loss_spans"),
    )


def format_chats(events: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """Fold and render; other columns are ignored, an empty log gives no rows."""
    wanted = events.select("conv_id", "message", "seq", "kind", "role", "text")
    return render(fold_events(wanted), learn_from)


def blocks_of(formatted: Column) -> Column:
    """The turns of a formatted string, each without its end mark."""
    parts = F.split(formatted, F.lit("<\\|end\\|>"), F.lit(-1))
    return F.slice(parts, 1, F.size(parts) - 1)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    body = F.transform(blocks_of(formatted), lambda b: F.split(F.substring(b, len(TURN) + 1, 2147483647), F.lit("<\\|body\\|>"), F.lit(-1)))
    return F.transform(body, lambda p: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(F.get(p, F.lit(1))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order, unescaped, as one string."""
    masked = F.get(F.transform(F.array(blocks_of(formatted)), lambda blocks: F.transform(
        spans, lambda s: F.substr(F.get(blocks, s["turn"]), s["start"] + 1, s["length"]))), F.lit(0))
    return unescape(F.array_join(masked, ""))
