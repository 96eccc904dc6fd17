"""Chat formatting from event logs, in DataFrame operations only.

A conversation is the fold of its log: messages start, deltas add to them, edits
replace them, regenerations start them anew and drop what followed. The events of
a conversation are dealt out by its id and sorted by sequence; which events count
and where a message lies in the output are running sums over that order, so no
step goes back over a conversation's earlier rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template: a turn is OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def escape(text: Column) -> Column:
    """Writes backslash and < as two signs each, so that no mark can begin inside a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """Also writes the bar as two signs, which ends a role."""
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\p"), F.lit("|")))


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, turn, role, text) of a log (conv_id, seq, turn, role, kind, text).

    Kinds: ``message`` and ``edit`` begin a turn's text anew with theirs, ``delta``
    adds to it, ``regenerate`` begins it anew and takes back all later turns that
    came before in the log. Other kinds and null ones are ignored. A turn's role is
    the last one given. Events of equal seq are taken in the order of kind
    (message, edit, regenerate, delta), then text. Null texts add nothing; a null
    turn or conv_id is one of its own; repeated rows are repeated events.
    """
    kinds = F.array_position(F.array(*map(F.lit, ("message", "edit", "regenerate", "delta"))), F.col("kind"))
    known = events.select("conv_id", "seq", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), kinds.alias("kind")).where("kind > 0")
    later = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "text")
    rewound = F.max(F.when(F.col("kind") == 3, F.col("seq"))).over(later)
    valid = known.withColumn("rewound", rewound).where("rewound IS NULL OR seq >= rewound")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    version = valid.withColumns({"version": F.count_if(F.col("kind") <= 3).over(so_far), "role": F.last("role", ignorenulls=True).over(so_far)})
    last = version.withColumn("newest", F.max("version").over(Window.partitionBy("conv_id", "turn"))).where("version = newest")
    parts = F.sort_array(F.collect_list(F.struct("seq", "kind", "text")))
    role = F.max_by("role", F.struct("seq", "kind", "text"))
    return last.groupBy("conv_id", "turn").agg(role.alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def format_chats(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Renders final messages (conv_id, turn, role, text) with a loss mask.

    Returns per conversation conv_id, formatted, and mask: the byte ranges (of UTF-8,
    half open, in order) of the texts of the trained role, as escaped there. Turns
    are in the order of turn, then role, then text; null roles and texts are empty;
    repeated rows are turns of their own. An empty table gives no rows.
    """
    clean = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    drawn = clean.withColumns({"piece": F.concat(head, body, F.lit(END)), "head": F.octet_length(head), "body": F.octet_length(body), "place": F.row_number().over(order)})
    ended = F.sum(F.octet_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = drawn.withColumn("start", ended - F.octet_length("piece") + F.col("head"))
    span = F.when(F.col("role") == trained_role, F.struct(F.col("start").alias("start"), (F.col("start") + F.col("body")).alias("end")))
    turns = F.sort_array(F.collect_list(F.struct("place", "piece")))
    return placed.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["piece"]), "").alias("formatted"), F.sort_array(F.collect_list(span)).alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, in order."""
    parts = F.split(formatted, F.lit(r"<\|end\|>\n"))
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    role = lambda x: F.substring_index(x, CLOSE, 1)
    return F.transform(whole, lambda x: F.struct(unescape_role(F.substring(role(x), len(OPEN) + 1, 1 << 30)).alias("role"), unescape(F.substr(x, F.length(role(x)) + len(CLOSE) + 1)).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    raw = formatted.cast("binary")
    return unescape(F.array_join(F.transform(mask, lambda x: F.substr(raw, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")).cast("string")), ""))
