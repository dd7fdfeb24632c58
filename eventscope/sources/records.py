"""Splittable read of CSV whose quoted fields hold line breaks.

Spark reads such a file in one task, as only a reader that starts at its first byte
knows which line breaks are quoted. Here the file is split as plain text is:

1. Each line is a function from "starts outside quotes" or "starts inside quotes" to
   the same for its end, found from its quote signs alone. Lines are written once, with
   that function, to the shared folder.
2. Functions of the lines with quote signs (no texts) are put together in order inside each
   block of a file, then one row a block along the file: now every block's start is known.
3. A stretch from an opening to its closing line is a record. Stretches are cut at
   chunks of ``2 ** CHUNK_BITS`` lines and joined to the lines by chunk; only lines of records
   with line breaks are gathered, all other lines are records where they stand.

No task sees more than a block of the file (``spark.sql.files.maxPartitionBytes``), one row a
block, or the lines of one record, whatever the size of the file. Compressed files
are one block, as they cannot be split at all.

Defined results: lines end at ``\\n`` or ``\\r\\n``; blank lines between records are no rows; an
empty file has none; with a header, the first record of each file is dropped. A file that ends inside a quoted
field has no end of its last record: each of that record's lines is a corrupt row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.staging import shared_folder, staged
from .events import CORRUPT_COLUMN, EVENT_COLUMNS, parsed_line

# Lines of a chunk, as a power of two: how many rows at most are compared with a chunk's stretches.
CHUNK_BITS = 7

# Where a reader stands: in the text of an unquoted field, at the start of a field, inside quotes, or
# behind a quote sign that may close the field or be the first of a doubled one.
_TEXT, _START, _QUOTED, _CLOSED = range(4)


def _rest(piece: Column, if_empty: int) -> Column:
    """The state behind an unquoted piece of a line."""
    return F.when(piece == "", F.lit(if_empty)).when(piece.endswith(","), F.lit(_START)).otherwise(F.lit(_TEXT))


def _ends_inside(value: Column, inside: bool) -> Column:
    """Whether a line that starts inside (or outside) quotes ends inside them."""
    pieces = F.split(value, '"')

    def step(state: Column, piece: Column) -> Column:
        # a quote sign, then the piece up to the next one
        return (
            F.when(state == -1, F.lit(_QUOTED) if inside else _rest(piece, _START))
            .when((state == _START) | (state == _CLOSED), F.lit(_QUOTED))
            .when(state == _QUOTED, _rest(piece, _CLOSED))
            .otherwise(_rest(piece, _TEXT))
        )

    end = F.aggregate(pieces, F.lit(-1), step) == _QUOTED
    return F.when(value.contains('"'), end).otherwise(F.lit(inside)).cast("int")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, at, value, from_out, from_in``: lines with their places and functions, written once.

    ``at`` grows along a block; its values come from the partitions of this read, so they are
    kept in a table and never computed a second time.
    """
    if shared_folder(spark) is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder: lines of split files are kept there")
    text = spark.read.option("lineSep", "\n").text(path)
    placed = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    return staged(placed.withColumn("from_out", _ends_inside(F.col("value"), False)).withColumn("from_in", _ends_inside(F.col("value"), True)))


def _composed(order: Window, from_out: Column, from_in: Column) -> tuple[Column, Column]:
    """The functions put together up to the current row, as ``(constant or NULL, swaps modulo 2)``.

    A function is the identity, the swap or a constant: what follows the last constant is a number of swaps.
    """
    swaps = F.sum(((from_out == 1) & (from_in == 0)).cast("int")).over(order) % 2
    constant = F.last(F.when(from_out == from_in, from_out.bitwiseXOR(swaps.cast("int"))), ignorenulls=True).over(order)
    return constant, swaps.cast("int")


def _applied(constant: Column, swaps: Column, start: Column) -> Column:
    return F.coalesce(constant, start).bitwiseXOR(swaps)


def _blocks(lines: DataFrame, quoted: DataFrame) -> DataFrame:
    """``file, block, lo, hi, starts, ends``: the places of a block's lines and whether it starts and ends inside quotes."""
    whole = quoted.groupBy("file", "block").agg(F.max_by(F.struct("constant", "swaps"), "at").alias("f"))
    places = lines.groupBy("file", "block").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = places.join(whole, ["file", "block"], "left").select(
        "file", "block", "lo", "hi",
        *[_applied(F.col("f.constant"), F.coalesce("f.swaps", F.lit(0)), F.lit(s)).alias(c) for s, c in ((0, "from_out"), (1, "from_in"))],
    )
    constant, swaps = _composed(along, F.col("from_out"), F.col("from_in"))
    ended = one.select("file", "block", "lo", "hi", _applied(constant, swaps, F.lit(0)).alias("ends"))
    before = F.lag("ends", 1, 0).over(Window.partitionBy("file").orderBy("block"))
    return ended.withColumn("starts", before)


def _stretches(lines: DataFrame) -> DataFrame:
    """``record, block, lo, hi, complete``: places of the lines of records with line breaks, cut at blocks; ``record`` is the first line's place."""
    in_block = Window.partitionBy("file", "block").orderBy("at")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lines.where(F.col("value").contains('"')).select("file", "block", "at", "from_out", "from_in")
    constant, swaps = _composed(so_far, F.col("from_out"), F.col("from_in"))
    quoted = held.select("file", "block", "at", constant.alias("constant"), swaps.alias("swaps"))
    blocks = staged(_blocks(lines, quoted))
    after = _applied(F.col("constant"), F.col("swaps"), F.col("starts"))
    known = quoted.join(blocks, ["file", "block"]).withColumn("after", after)
    known = known.withColumn("before", F.lag("after", 1).over(in_block))
    turns = known.withColumn("before", F.coalesce("before", "starts")).where("before <> after")
    turns = staged(turns.withColumn("next", F.lead("at", 1).over(in_block)).select("file", "block", "at", "after", "next", "hi"))
    # the record that is open at the end of a block was opened in it or is carried from an earlier one
    last = turns.where("after = 1").groupBy("file", "block").agg(F.max("at").alias("opened"))
    first = turns.where("after = 0").groupBy("file", "block").agg(F.min("at").alias("closed"))
    along = Window.partitionBy("file").orderBy("block")
    carried = F.last("opened", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    open_blocks = blocks.join(last, ["file", "block"], "left").withColumn("carried", carried).join(first, ["file", "block"], "left")
    begun = open_blocks.where("starts = 1").select("block", F.col("carried").alias("record"), "lo", F.coalesce("closed", "hi").alias("hi"))
    own = turns.where("after = 1").select("block", F.col("at").alias("record"), F.col("at").alias("lo"), F.coalesce("next", "hi").alias("hi"))
    endless = (
        open_blocks.withColumn("held", F.coalesce("opened", "carried"))
        .groupBy("file").agg(F.max_by(F.struct("ends", "held"), "block").alias("e")).where("e.ends = 1").select(F.col("e.held").alias("endless"))
    )
    both = own.unionByName(begun)
    return both.join(endless, F.col("record") == F.col("endless"), "left").select("record", "block", "lo", "hi", F.col("endless").isNull().alias("complete"))


def _blank() -> Column:
    return F.col("value").rlike(r"\A[\x00-\x20]*\z")


def csv_records(spark: SparkSession, path: str | list[str], *, header: bool = True) -> DataFrame:
    """``value, complete``: the records of CSV file(s), each with its line breaks; False for lines of one that never ends."""
    lines = _lines(spark, path)
    chunk = F.shiftright("at", CHUNK_BITS)
    pieces = staged(
        _stretches(lines).withColumn("chunk", F.explode(F.sequence(F.shiftright("lo", CHUNK_BITS), F.shiftright("hi", CHUNK_BITS))))
    )
    texts = lines.select("at", "value")
    inside = (chunk == F.col("chunk")) & F.col("at").between(F.col("lo"), F.col("hi"))
    # each text hangs on a column of the other side: else a later filter that raises on malformed texts
    # could move below the join and see lines that are no records
    members = texts.join(pieces, inside).withColumn("value", F.when(F.col("at") >= F.col("lo"), F.col("value")))
    alone = texts.join(pieces, inside, "left").where(F.col("record").isNull())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"])
    gathered = members.where("complete").groupBy("record").agg(F.concat_ws("\n", ordered).alias("value"))
    found = (
        alone.select("at", F.when(F.coalesce("lo", "at") == F.col("at"), F.col("value")).alias("value"), F.lit(True).alias("complete"))
        .unionByName(gathered.select(F.col("record").alias("at"), "value", F.lit(True).alias("complete")))
        .unionByName(members.where("NOT complete").select("at", "value", "complete"))
    )
    found = found.where(~_blank()).withColumn("value", F.regexp_replace("value", "\\r\\z", ""))
    if header:
        heads = lines.where(~_blank()).groupBy("file").agg(F.min_by("at", F.struct("block", "at")).alias("head")).select("head")
        found = found.join(heads, F.col("at") == F.col("head"), "left").where(F.col("head").isNull())
        found = found.withColumn("value", F.when(F.coalesce("head", "at") == F.col("at"), F.col("value")))
    return found.select("value", "complete")


def load_records(spark: SparkSession, path: str | list[str], *, header: bool = True) -> DataFrame:
    """The columns of :func:`~eventscope.sources.events.load_events` from files whose quoted fields may hold line breaks."""
    records = csv_records(spark, path, header=header)
    row = records.select("complete", "value", parsed_line("value").alias("row"))
    fields = [F.when(F.col("complete"), F.col(f"row.{c}")).alias(c) for c in EVENT_COLUMNS]
    corrupt = F.when(F.col("complete"), F.col(f"row.{CORRUPT_COLUMN}")).otherwise(F.col("value"))
    return row.select(*fields, corrupt.alias(CORRUPT_COLUMN))
