"""Chat logs: event-sourced reconstruction and reversible rendering, in DataFrame functions only.

A log has one row per event: conv_id, seq, message_id, kind, role, text. Kinds: ``start`` opens a message
with its role and first text, ``delta`` appends, ``edit`` replaces the text, ``regenerate`` empties it for
the deltas that follow. ``reconstruct`` folds each message's events in order of seq (ties: by kind as
listed, then text) into its final role and text; messages stand in order of their first seq, then id.
``render`` writes conversations as

    <|im_start|>role<|im_sep|>text<|im_end|>\\n

per turn, with loss spans over the assistant's texts. Control strings inside roles and texts are broken by
a backslash after their first character and backslashes are doubled, so the template's own strings occur
nowhere else and ``read_back`` restores every text exactly.

Events of a message meet by (conversation, message), turns of a conversation by conversation, as one row
of output holds the whole of it; nothing larger is gathered.

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own; events of kinds
not listed add nothing; a message without a start has the first role given, else an empty one; an
event delivered twice (equal in all its columns) counts once (turns of ``turn_events`` are kept apart by a row number); empty tables give
empty tables; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("start", "edit", "regenerate", "delta")
OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Where a control string begins: those of this template and of other common ones (<s>, </s>, <<SYS>>, [INST]).
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_events(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text rows as a log. Turns arrive as real ones do: whole, in two deltas, as a draft that is regenerated, or as a first wording that is edited, by turns."""
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    head, tail = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    no_role = F.lit(None).cast("string")
    e = lambda kind, body, role=no_role: F.struct(F.lit(kind).alias("kind"), role.alias("role"), body.alias("text"))
    role, none = F.coalesce("role", F.lit("")), F.lit("")
    ways = [
        F.array(e("start", text, role)),
        F.array(e("start", head, role), e("delta", tail)),
        F.array(e("start", none, role), e("delta", F.concat(tail, head)), e("regenerate", none), e("delta", head), e("delta", tail)),
        F.array(e("start", F.upper(text), role), e("edit", text)),
    ]
    numbered = turns.select("conv_id", "turn", "role", "text").withColumn("message_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    way = F.col("message_id") % 4
    events = F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])
    return numbered.select("conv_id", "message_id", F.posexplode(events).alias("k", "e")).select("conv_id", (F.col("message_id") * 8 + F.col("k")).alias("seq"), "message_id", "e.kind", "e.role", "e.text")


def reconstruct(log: DataFrame) -> DataFrame:
    """conv_id, message_id, at (first seq), role, text of each message."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)), F.lit(len(KINDS)))
    resets = F.col("kind").isin("start", "edit", "regenerate")
    event = F.struct(F.col("seq").alias("seq"), rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.struct("seq", rank.alias("rank"))
    got = log.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("at"),
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.struct(F.col("seq"), rank.alias("rank"), F.col("role")))), F.lit("")).alias("role"),
        F.max(F.when(resets, place)).alias("reset"),
        F.sort_array(F.collect_set(F.when(F.col("kind").isin(*KINDS), event))).alias("events"),
    )
    # from the last reset on; a regenerated text begins empty
    live = F.filter("events", lambda x: F.col("reset").isNull() | (F.struct(x["seq"].alias("seq"), x["rank"].alias("rank")) >= F.col("reset")))
    piece = lambda x: F.when(x["rank"] == KINDS.index("regenerate"), F.lit("")).otherwise(x["text"])
    return got.select("conv_id", "message_id", "at", "role", F.array_join(F.transform(live, piece), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and per turn a span (start of the turn, loss_start, loss_end) in code points; the last two are equal where nothing is learned."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    before = F.concat(F.lit(OPEN), role, F.lit(SEP))
    turns = messages.select("conv_id", "at", "message_id", F.concat(before, text, F.lit(CLOSE)).alias("s"), F.length(before).alias("from"), F.when(F.col("role") == loss_role, F.length(text)).otherwise(0).alias("n"))
    w = Window.partitionBy("conv_id").orderBy("at", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("s")).over(w), F.lit(0)))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "message_id", "start", "from", "n", "s"))).alias("t"))
    span = lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["from"]).alias("loss_start"), (x["start"] + x["from"] + x["n"]).alias("loss_end"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"), F.transform("t", span).alias("spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, loss: the part under the mask), all from formatted and spans."""
    pieces = F.filter(F.split("formatted", r"(?<=<\|im_end\|>\n)"), lambda s: s != "")
    pattern = r"(?s)^<\|im_start\|>(.*?)<\|im_sep\|>(.*)<\|im_end\|>\n$"

    def turn(s: Column, p: Column) -> Column:
        loss = s.substr((p["loss_start"] - p["start"] + 1).cast("int"), (p["loss_end"] - p["loss_start"]).cast("int"))
        return F.struct(unescape(F.regexp_extract(s, pattern, 1)).alias("role"), unescape(F.regexp_extract(s, pattern, 2)).alias("text"), unescape(loss).alias("loss"))

    return rendered.select("conv_id", F.zip_with(pieces, "spans", turn).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    """n_turns, digests of all turns and of the learned text."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
