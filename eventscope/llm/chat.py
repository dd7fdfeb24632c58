"""Chat formatting by grammar round trip (DataFrame and SQL functions only).

Template, per turn: ``<|im_start|>{role}\\n{text}<|im_end|>\\n``. A turn is first
rendered with its content as it is and parsed again by the deterministic
parser. Where the parser does not give back exactly the source turn, the
content is escaped and the turn rendered anew; escaped content always parses
back. The finished conversation is parsed once more as a whole.

Parser: turns start at ``<|im_start|>``; the role ends at the first newline,
the text at the first ``<|im_end|>``; then ``<!`` + ``!``* + ``|`` in a text loses one
``!`` and ``%25`` / ``%0A`` / ``%3C`` in a role become ``%``, newline, ``<``.

Escapes (reversible): every ``<`` + ``!``* + ``|`` in a text gets one more ``!`` behind its
``<``, so no control string is left; in a role ``%``, newline and ``<`` become ``%25``,
``%0A``, ``%3C``.

Defined results: a NULL role or text counts as empty; turns that share a number
are ordered by role, then text; NULL turn numbers come first; repeated rows are
repeated turns; NULL ``conv_id`` is a conversation of its own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(col: Column) -> Column:
    return F.regexp_replace(col, r"<(!*)\|", r"<!$1|")


def unescape_text(col: Column) -> Column:
    return F.regexp_replace(col, r"<!(!*)\|", r"<$1|")


def escape_role(col: Column) -> Column:
    return F.replace(F.replace(F.replace(col, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(col: Column) -> Column:
    return F.replace(F.replace(F.replace(col, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """Rendered text -> array of ``struct<role, text>``, escapes undone."""
    blocks = F.split(rendered, r"\Q" + START + r"\E", -1)
    body = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turn(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        rest = F.substring(block, F.length(role) + 2, F.length(block))
        return F.struct(
            unescape_role(role).alias("role"), unescape_text(F.substring_index(rest, END, 1)).alias("text")
        )

    return F.transform(body, turn)


def format_conversations(
    conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, formatted, turns, loss_spans, round_trip_ok``, one row per conversation.

    ``formatted`` is the rendered text, ``turns`` the turns read back from it,
    ``loss_spans`` the code point spans ``[start, end)`` of assistant texts in it.
    """
    src = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        text_or_empty(role).alias("role"), text_or_empty(text).alias("text"),
    )
    source = F.array(F.struct("role", "text"))
    plain = src.withColumn("clean", parse(render_turn(F.col("role"), F.col("text"))) == source)
    shown = plain.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("clean"), F.col("role")).otherwise(escape_role(F.col("role"))).alias("shown_role"),
        F.when(F.col("clean"), F.col("text")).otherwise(escape_text(F.col("text"))).alias("shown_text"),
    ).withColumn("rendered", render_turn(F.col("shown_role"), F.col("shown_text")))

    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.coalesce(
        F.sum(F.length("rendered").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    start = before + F.length(F.lit(START)) + F.length("shown_role") + 1
    placed = shown.select(
        "conv_id", "role", "text", "rendered",
        F.row_number().over(order).alias("seq"),
        F.when(
            F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("shown_text")).alias("end"))
        ).alias("span"),
    )
    whole = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "role", "text", "rendered", "span"))).alias("t")
    )
    formatted = whole.select(
        "conv_id",
        F.array_join(F.col("t.rendered"), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )
    return formatted.withColumn("turns", parse(F.col("formatted"))).select(
        "conv_id", "formatted", "turns", "loss_spans", (F.col("turns") == F.col("source")).alias("round_trip_ok")
    )


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped text under the loss mask, texts in order with nothing between."""
    parts = F.transform(
        loss_spans,
        lambda s: unescape_text(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return F.array_join(parts, "")
