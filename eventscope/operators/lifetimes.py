"""User lives as bit sets of months, merged without reading old events again.

A user's active months are bits: month ``m`` (see ``month_index``) is bit ``m % 60`` of word
``m div 60``. One row per user and word is the state; it is a ``bit_or`` of events, and of
other states, so a new month's events are merged with the stored table by
their users' words alone. Events without a user keep one word row too (the data's
last month is that of all events), events without a time a row without a word.

Cohort, last month and every cell follow by bit functions. Users who share their
whole life are counted before any month is listed, so that the cells come from the
distinct lives, not from user-months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import month_from_index, month_index

WORD = 60  # months in a word: five years, below the sign bit


def user_months(events: DataFrame, *, user: str = "user_id", time: str = "event_time") -> DataFrame:
    """``user, word, bits``: the state of these events."""
    month = events.select(F.col(user), month_index(time).alias("_m"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_m", F.lit(WORD)))
    return month.groupBy(user, F.floor(F.col("_m") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def merge_months(*states: DataFrame) -> DataFrame:
    """The state of all events behind ``states``; a month that several of them hold counts once."""
    both = states[0]
    for other in states[1:]:
        both = both.unionByName(other)
    keys = [c for c in both.columns if c != "bits"]
    return both.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))


def lowest(bits: Column) -> Column:
    """Place of the lowest bit of a positive number."""
    return F.bit_count(bits.bitwiseAND(-bits) - 1)


def highest(bits: Column) -> Column:
    """Place of the highest bit of a positive number."""
    return F.length(F.bin(bits)) - 1


def lifetimes(state: DataFrame, *, user: str = "user_id") -> DataFrame:
    """``user, life array<struct<word, bits>>, first, last, timeless`` of each known user (months as ``month_index``; NULL without a time)."""
    words = F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "bits"))))
    per_user = state.where(F.col(user).isNotNull()).groupBy(user).agg(words.alias("life"), (F.count_if(F.col("word").isNull()) > 0).alias("timeless"))
    head, tail = F.get("life", F.lit(0)), F.get("life", F.size("life") - 1)
    return per_user.select(
        user, "life",
        (head["word"] * WORD + lowest(head["bits"])).cast("int").alias("first"),
        (tail["word"] * WORD + highest(tail["bits"])).cast("int").alias("last"),
        "timeless",
    )


def months_of(life: Column) -> Column:
    """The months of a life, in order."""
    places = F.sequence(F.lit(0), F.lit(WORD - 1))
    return F.flatten(F.transform(life, lambda w: F.transform(
        F.filter(places, lambda b: F.getbit(w["bits"], b) == 1), lambda b: w["word"] * WORD + b
    )))


def cells_from_months(state: DataFrame, *, user: str = "user_id") -> DataFrame:
    """The cells of :func:`eventscope.operators.retention.cohort_cells`, from a state."""
    lives = lifetimes(state, user=user).groupBy("first", "last", "life", "timeless").agg(F.count(F.lit(1)).alias("users"))
    # a user's events without a time are a cell of their own
    months = F.concat(months_of(F.col("life")), F.when(F.col("timeless"), F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>")))
    spread = lives.select("first", "last", "users", F.explode(months).alias("month"))
    # one row: the last month of all events, unknown users included
    bound = state.where("word IS NOT NULL").agg(F.max(F.col("word") * WORD + highest(F.col("bits"))).cast("int").alias("_data_last"))
    cells = spread.groupBy("first", (F.col("month") - F.col("first")).alias("month_num")).agg(
        F.sum("users").alias("active_users"),
        F.coalesce(F.sum(F.when(F.col("month") == F.col("last"), F.col("users"))), F.lit(0)).alias("lapsed_users"),
    )
    return cells.crossJoin(F.broadcast(bound)).select(
        month_from_index("first").alias("cohort_month"), "month_num", "active_users", "lapsed_users", month_from_index("_data_last").alias("data_last_month")
    )
