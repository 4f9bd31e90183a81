"""Chat formatting: final messages from an event log, rendered by a reversible template. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of the template, and marks of common templates that a text must not be able to forge.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
FOREIGN = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|"]

#: Control strings begin with one of these; a backslash after the first character breaks them.
_OPENERS = r"(<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\]))"


def escape(text: Column) -> Column:
    """Backslashes doubled, and a backslash put into every control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _OPENERS, r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: a backslash stands for the character that follows it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def recorded_log(messages: DataFrame) -> DataFrame:
    """The log of a streamed session that ends in ``messages`` (conv_id, message from 1, role, text), for ``fold_events``.

    Each text arrives as four deltas. By a hash of the message, one in three has a first try that was regenerated, and one
    in three a draft that an edit replaced by the first quarter of the final text before the rest was streamed. Events of
    a message have the numbers 16 * message and on. Null texts are empty; an empty table has an empty log.
    """
    text = F.coalesce("text", F.lit(""))
    told = messages.select("conv_id", "message", "role", text.alias("text"), F.pmod(F.xxhash64("message", text), F.lit(3)).alias("way"))
    size = F.ceil(F.length("text") / 4).cast("int")
    quarter = [F.substr("text", F.lit(i) * size + 1, size) for i in range(4)]

    def event(step: int, kind: str, written: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), written.alias("text"))

    rest = [event(8 + i, "delta", quarter[i]) for i in (1, 2, 3)]
    retried = F.array(event(0, "delta", F.reverse("text")), event(1, "regenerate", F.lit("")), event(8, "delta", quarter[0]), *rest)
    edited = F.array(event(0, "delta", F.reverse("text")), event(1, "delta", F.lit("?")), event(8, "edit", quarter[0]), *rest)
    plain = F.array(event(8, "delta", quarter[0]), *rest)
    events = F.when(F.col("way") == 0, retried).when(F.col("way") == 1, edited).otherwise(plain)
    logged = told.select("conv_id", "message", "role", F.inline(events))
    return logged.select("conv_id", (F.col("message") * 16 + F.col("step")).alias("seq"), "message", "kind", "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of conversations from their log.

    ``events``: conv_id, seq (order within the conversation), message (place of the message it
    belongs to), kind, role, text. Kinds: ``delta`` adds text to the end of the message, ``edit``
    replaces its text, ``regenerate`` discards it and all later messages so far; what follows
    writes them anew. Returns conv_id, message, role (of the last event that has one), text.

    Null texts are empty, null roles too; events without conversation are the conversation null, a null
    message stands before all others; events of equal seq go by kind (regenerate, edit, delta), then
    message, role, text; repeated events all count; a log without events has no messages. A message
    that ends with no event after its last discard does not exist. Time grows with the events: the
    last discard is carried from message to message, never joined.
    """
    rank = F.when(F.col("kind") == "regenerate", 0).when(F.col("kind") == "edit", 1).otherwise(2)
    discarding = F.col("kind") == "regenerate"
    log = events.select(
        "conv_id",
        "message",
        F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.struct(F.col("seq"), rank.alias("rank")).alias("at"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    written = log.groupBy("conv_id", "message").agg(
        F.max(F.when(discarding, F.col("at"))).alias("discard"),
        F.array_sort(F.collect_list(F.when(~discarding, F.struct("at", "role", "text", "kind")))).alias("events"),
    )
    # The last discard of a message is that of the last regeneration at it or before it.
    so_far = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    left = written.withColumn("discard", F.max("discard").over(so_far)).withColumn(
        "events", F.filter("events", lambda e: F.col("discard").isNull() | (e["at"] > F.col("discard")))
    )
    last_edit = F.array_max(F.transform(F.filter("events", lambda e: e["kind"] == "edit"), lambda e: e["at"]))
    # Generators make each array once, also where it is read within a lambda.
    left = left.where(F.size("events") > 0).select("conv_id", "message", F.inline(F.array(F.struct("events", last_edit.alias("last_edit")))))
    kept = F.filter("events", lambda e: F.col("last_edit").isNull() | (e["at"] >= F.col("last_edit")))
    roles = F.filter("events", lambda e: e["role"].isNotNull())
    return left.select(
        "conv_id",
        "message",
        F.coalesce(F.try_element_at(F.transform(roles, lambda e: e["role"]), F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, and loss_spans (start, length in code points of learned texts, number of their turn from 1).

    ``messages``: conv_id, message, role, text. Messages go by ``message``, ties by role and text.
    Roles and texts are escaped, so ``read_back`` gives them back exactly. Null
    roles and texts are empty. A conversation is one row, as long as its texts are together.
    """
    order = Window.partitionBy("conv_id").orderBy("message", "role", "text")
    turns = messages.select(
        "conv_id",
        "message",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "conv_id",
        "message",
        "role",
        "text",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    size = F.length("head") + F.length("body") + F.lit(len(END))
    placed = turns.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        F.concat("head", "body", F.lit(END)).alias("turn"),
        F.when(
            F.col("role") == learned_role,
            F.struct((F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(END)).alias("start"), F.length("body").cast("long").alias("length"), F.row_number().over(order).alias("turn")),
        ).alias("span"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "turn", "span"))).alias("turns"))
    rendered = F.struct(
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )
    # As the output of a generator the text is made once, also where it is read within a lambda.
    return whole.select("conv_id", F.inline_outer(F.array(rendered)))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` (formatted, loss_spans, any more columns) with turns, an array of (role, text), and loss, all text under
    the loss mask, unescaped, nothing between.

    The text is cut once, at the ends of turns, and a span is read within its turn, so time grows with the text.
    """
    parts = F.filter(F.split("formatted", r"<\|end\|>"), lambda t: t != "")
    cut = chats.select("*", F.inline(F.array(F.struct(parts.alias("_parts")))))
    turns = F.transform(
        "_parts",
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
            unescape(F.substring_index(t, TEXT, -1)).alias("text"),
        ),
    )

    def body(span: Column) -> Column:
        turn = F.element_at("_parts", span["turn"])
        return F.substr(turn, F.length(F.substring_index(turn, TEXT, 1)) + len(TEXT) + 1, span["length"].cast("int"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(body(s))), "")
    return cut.select(*chats.columns, turns.alias("turns"), loss.alias("loss"))
