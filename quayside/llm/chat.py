"""Chat formatting by event sourcing (operator 6), in DataFrame functions only.

Events of a log are gathered per message, ordered by sequence and folded:
`message` and `edit` set the text, `regenerate` starts it anew, `delta` adds to
it. Messages of a conversation are then ordered and rendered. The template's
control strings all open with `<|`; in roles and texts a mark follows every
`<`, `[` and mark, so no control string of this or another common template
survives in them, and dropping one mark after each restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed control strings
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MARK = "␛"
KINDS = ("message", "regenerate", "edit", "delta")  # order of events that share a sequence number


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[{MARK}])", f"$1{MARK}")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[{MARK}]){MARK}", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, seq, role, text) from events (conv_id, message, seq,
    kind, role, text); seq is the message's first.

    Events that share a sequence number go by kind, then text. A null kind is
    a message, a null text or role empty; the role is the last one given. An
    event that repeats exactly counts once (a log may deliver it again).
    Rows with a null conv_id or message belong together.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.coalesce("kind", F.lit("message"))), F.lit(0)).cast("int")
    one = F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), "role")
    log = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_set(one)).alias("log"))
    text = F.aggregate("log", F.lit(""), lambda acc, e: F.when(e["rank"] == 4, F.concat(acc, e["text"])).otherwise(e["text"]))
    role = F.aggregate("log", F.lit(None).cast("string"), lambda acc, e: F.coalesce(e["role"], acc))
    return log.select("conv_id", "message", F.col("log")[0]["seq"].alias("seq"), F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation; spans are code point
    ranges of the formatted string, end exclusive, that carry loss. Messages
    that share a sequence number go by message."""
    turns = F.array_sort(F.collect_list(F.struct("seq", "message", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), F.col("role").isin(*loss_roles).alias("loss"))))
    held = messages.groupBy("conv_id").agg(turns.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END))), "")
    empty = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("spans"), F.lit(0).alias("at"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + len(START) + len(SEP) + F.length(t["role"])
        last = first + F.length(t["text"])
        spans = F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(first.alias("s"), last.alias("e"))))).otherwise(acc["spans"])
        return F.struct(spans.alias("spans"), (last + len(END)).alias("at"))

    return held.select("conv_id", formatted.alias("formatted"), F.aggregate("turns", empty, step, lambda acc: acc["spans"]).alias("loss_spans"))


def read_back(rendered: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turns, formatted): turns array<struct<role, text, loss>> parsed
    from the formatted string alone."""
    pieces = F.split("formatted", r"<\|im_end\|>")
    whole = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    parts = F.transform(whole, lambda p: F.split(F.substring(p, len(START) + 1, 1 << 30), r"<\|im_sep\|>"))
    turns = F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    return rendered.select("conv_id", turns.alias("turns"), "formatted").withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["role"].isin(*loss_roles).alias("loss"))))


def format_logs(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """render() of fold_events(). A conversation is one string in one row, by
    nature; its messages are folded apart, so only they meet in a task. An
    empty table gives no rows; other columns are ignored."""
    return render(fold_events(events), loss_roles)


def table_events(rows: DataFrame) -> DataFrame:
    """A table of finished turns as a log. Rows that share a turn are messages
    of their own, in the order of role and text; exact repeats are numbered."""
    counted = rows.groupBy("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).count()
    again = F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy")
    one = counted.select("conv_id", "turn", "role", "text", again)
    return one.select("conv_id", F.struct("turn", "role", "text", "copy").alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def digests(rendered: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted strings say."""
    told = read_back(rendered)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
