"""Chat formatting: event-sourced reconstruction of conversations.

A log has one row for each event of a conversation, ordered by ``seq``:

* ``open`` starts message ``msg`` with a role and its first text,
* ``delta`` appends text to it,
* ``edit`` puts its text in place of all before it,
* ``regenerate`` discards the message's text and every later message so far.

The log is partitioned by conversation and folded with windows (each in linear
time): an event counts unless a later edit of its message, or a regeneration of
its message or an earlier one, follows it. Messages are rendered by a template
that marks turns and escapes its control strings, with the loss mask as spans
of the output. All of it is built-in expressions.

Defined results: a null text or role is empty; a null conversation id is a
conversation of its own; events that agree in ``seq`` are folded by kind (delta,
edit, open, regenerate), then text, the later of two edits winning; equal events
are one after the other; extra columns are not read; a conversation without events gives no row, a message whose events were
all discarded no turn. One row holds one conversation, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template. Every control string begins with "<", which no escaped text has:
# a backslash becomes \s and a "<" becomes \l.
OPEN, ROLE, CLOSE = "<turn>", "</role>\n", "</turn>\n"


def escape(column: Column) -> Column:
    return F.replace(F.replace(column, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(column: str) -> str:
    """SQL that undoes ``escape``: a backslash always begins one of its two pairs."""
    return rf"replace(replace({column}, '\\l', '<'), '\\s', '\\')"


def as_events(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Finished turns as a log: one ``open`` event for each row, by turn, role and text."""
    order = Window.partitionBy(conv).orderBy(turn, role, text)
    return df.select(
        F.col(conv).alias("conv_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.lit("open").alias("kind"),
        F.row_number().over(order).cast("long").alias("msg"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text) of the messages that remain."""
    own = Window.partitionBy("conv_id", "msg")
    upto = Window.partitionBy("conv_id").orderBy("msg")
    kind = F.col("kind")
    out = events.select("conv_id", "msg", "role", F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")).alias("at"), "kind")
    out = out.withColumn("reset", F.max(F.when(kind == "regenerate", F.col("at"))).over(upto))
    out = out.withColumn("edited", F.max(F.when(kind == "edit", F.col("at"))).over(own))
    out = out.withColumn("said", F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("at", "role"))).over(own))
    out = out.withColumn("since", F.greatest("reset", "edited"))
    alive = F.col("since").isNull() | (F.col("at") >= F.col("since"))
    out = out.where(alive).groupBy("conv_id", "msg").agg(F.first("said").alias("role"), F.first("since").alias("since"), F.array_sort(F.collect_list("at")).alias("parts"))
    # Of equal edits or regenerations the last one counts, and only it.
    parts = "filter(parts, (x, i) -> i = 0 OR NOT coalesce(x = since AND x = get(parts, i - 1), false))"
    return out.select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), F.expr(f"array_join(transform({parts}, x -> x.text), '')").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, starts array<long>, loss array<struct<start, end, turn>>).

    In code points, end exclusive: where each turn starts in the output, and the
    learnt spans with the number of the turn that holds them.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE))
    out = messages.select("conv_id", "msg", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    out = out.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("msg")
    out = out.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    out = out.withColumn("turn", F.row_number().over(order) - 1).withColumn("start", F.col("at") + F.length("head"))
    span = F.when(F.col("role") == learn, F.struct("start", (F.col("start") + F.length("body")).alias("end"), "turn"))
    out = out.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "piece", "at", span.alias("span")))).alias("turns"))
    pieces = F.expr("array_join(transform(turns, x -> x.piece), '')").alias("formatted")
    return out.select("conv_id", pieces, F.expr("transform(turns, x -> x.at)").alias("starts"), F.expr("transform(filter(turns, x -> x.span IS NOT NULL), x -> x.span)").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``render``'s rows with the turns and the text under the mask parsed from the output.

    Each span is cut out of its own turn, so the work grows with the length of
    a conversation and not with its length times its turns.
    """
    blocks = F.expr(f"split(formatted, '{CLOSE[:-1]}\\n')")
    out = formatted.withColumn("blocks", F.slice(blocks, 1, F.size(blocks) - 1))
    skip = len(OPEN) + 1
    turn = f"named_struct('role', {unescape(f'substr(x, {skip}, instr(x, {chr(39)}</role>{chr(39)}) - {skip})')}, 'text', {unescape(f'substr(x, instr(x, {chr(39)}</role>{chr(39)}) + {len(ROLE)})')})"
    out = out.withColumn("turns", F.expr(f"transform(blocks, x -> {turn})"))
    masked = unescape("substr(blocks[x.turn], cast(x.start - starts[x.turn] as int) + 1, cast(x.end - x.start as int))")
    return out.withColumn("learnt", F.expr(f"array_join(transform(loss, x -> {masked}), '')")).drop("blocks")


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))
