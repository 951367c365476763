"""Chat formatting with Spark expressions only.

Method: turns are collected as structs and sorted by (turn, role, text); adjacent turns of one role are merged by array
functions into a block under one header; blocks are concatenated. The template:

    ### role ###
    text of a turn</turn>
    text of the next turn of the same role</turn>

Inside roles and texts, ``\\`` becomes ``\\\\``, ``#`` becomes ``\\h`` and ``<`` becomes ``\\l``, so a raw ``#`` or ``<`` is always the
template's own and every output can be taken apart again. The loss mask is a list of code point spans
of the formatted text, one for each turn of ``loss_role``; where a turn starts comes from running sums over the conversation,
in the same shuffle as the collection. A conversation becomes one row, so it must fit in a task; its rows meet nowhere
else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "### ", " ###\n", "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    slash, lt = F.lit("\\"), F.lit("<")
    doubled = F.replace(text, slash, F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("#"), F.lit("\\h")), lt, F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: between doubled backslashes, \\h and \\l stand for # and <."""
    part = lambda x: F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 loss_role: str = LOSS_ROLE) -> DataFrame:
    """``conv_id, formatted string, loss_spans array<struct<start, end>>``, one row for each conversation of ``df``.

    Null texts and roles count as empty; null turns come first; turns of one number are ordered by role, then text;
    repeated rows are turns of their own; rows with a null conv_id make one conversation; an empty table gives an
    empty table; other columns are not read. Spans count code points from 0, the end is exclusive.
    """
    pick = lambda c, kind: F.col(f"`{c}`").cast(kind)
    rows = df.select(
        pick(conv, "long").alias("conv_id"), pick(turn, "long").alias("turn"),
        F.coalesce(pick(role, "string"), F.lit("")).alias("role"), F.coalesce(pick(text, "string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumns({"esc_role": escape(F.col("role")), "esc_text": escape(F.col("text"))})
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    opens = ~F.lag("role").over(order).eqNullSafe(F.col("role"))
    head = F.when(F.col("opens"), F.length("esc_role") + len(OPEN) + len(CLOSE)).otherwise(0)
    rows = rows.withColumn("opens", opens).withColumn("head", head).withColumn("size", F.length("esc_text"))
    end = F.sum(F.col("head") + F.col("size") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END)
    rows = rows.withColumn("end", end.cast("long"))
    item = F.struct("end", "opens", "role", "esc_role", "esc_text", "size")  # end rises from turn to turn
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    starts = turns.withColumn(
        "starts", F.filter(F.transform("turns", lambda t, i: F.when(t["opens"], i + 1)), lambda i: i.isNotNull())
    )

    def block(at: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
        own = F.slice("turns", at, upto - at)
        body = F.array_join(F.transform(own, lambda t: F.concat(t["esc_text"], F.lit(END))), "")
        return F.concat(F.lit(OPEN), F.get("turns", at - 1)["esc_role"], F.lit(CLOSE), body)

    span = lambda t: F.struct((t["end"] - t["size"]).alias("start"), t["end"].alias("end"))
    return starts.select(
        "conv_id",
        F.array_join(F.transform("starts", block), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == loss_role), span).alias("loss_spans"),
    )


def parse_chats(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """``df`` with ``turns array<struct<role, text>>``, read back from the formatted text; an empty text has no turns."""
    pieces = F.split(F.col(formatted), "###")
    # outside of the lambda below, so that a conversation is split once and not for each block
    heads = F.filter(pieces, lambda x, i: i % 2 == 1)
    bodies = F.filter(pieces, lambda x, i: (i > 0) & (i % 2 == 0))

    def turns_of(block: Column) -> Column:
        role = unescape(F.substring(block["head"], F.lit(2), F.length(block["head"]) - 2))
        texts = F.split(F.substring(block["body"], F.lit(2), F.length(block["body"])), END)
        return F.transform(F.slice(texts, F.lit(1), F.size(texts) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.arrays_zip(heads.alias("head"), bodies.alias("body"))
    return df.withColumn("turns", F.flatten(F.transform(blocks, turns_of)))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, cut), "")
