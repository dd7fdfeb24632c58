"""Daily states of the users seen, rolled up to weeks and months without the events.

* Exact: users get dense numbers once (``number_users``, ``add_users``); a day's users are a
  bitmap per block of 32,768 numbers. Bitmaps of days are ``OR``-ed to those of a week or
  month, whose bits are counted: no distinct user is shuffled, a hot user is one bit.
* Estimated: a HyperLogLog sketch per day, a fixed size whatever the users.

Both tables are appended to day by day; a day that arrives in parts is merged by ``OR``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import month_label, month_start, week_start
from ..functions.staging import shared_folder, staged

SKETCH_BITS = 12  # log2 of a sketch's registers: about 1.6 % relative standard deviation


def _numbered(users: DataFrame, user: str, first: Column) -> DataFrame:
    """Distinct ``users`` with dense numbers from ``first`` on, counted per partition and offset by the partitions before."""
    # a number must not change between two reads
    if shared_folder(users.sparkSession) is None:
        raise ValueError("set spark.checkpoint.dir to a folder on shared storage")
    placed = staged(users.select(user, F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))
    within = F.col("_id") - F.shiftleft(part, 33)
    return placed.join(F.broadcast(offsets), part == F.col("_p")).select(user, (first + F.col("_before") + within).alias("number"))


def number_users(events: DataFrame, *, user: str = "user_id") -> DataFrame:
    """``user, number``: all known users, numbered from 0 without gaps (in no order). Keep it as a table."""
    return _numbered(events.where(F.col(user).isNotNull()).select(user).distinct(), user, F.lit(0))


def add_users(numbers: DataFrame, events: DataFrame, *, user: str = "user_id") -> DataFrame:
    """``numbers`` with the users of ``events`` that it lacks; known users keep theirs."""
    first = numbers.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    new = events.where(F.col(user).isNotNull()).select(user).distinct().join(numbers.select(user), user, "left_anti")
    return numbers.unionByName(_numbered(new, user, F.lit(first)))


def day_bitmaps(events: DataFrame, numbers: DataFrame, *, user: str = "user_id", time: str = "event_time") -> DataFrame:
    """``activity_date, block, bits``: who was seen on each day (a day of unknown users alone has a row without bits)."""
    seen = events.select(F.to_date(time).alias("activity_date"), F.col(user)).distinct().join(numbers, user, "left")
    at = F.col("number") + 1
    return seen.groupBy("activity_date", F.bitmap_bucket_number(at).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )


def merge_days(*days: DataFrame) -> DataFrame:
    """Day tables as one; parts of a day are joined."""
    both = days[0]
    for other in days[1:]:
        both = both.unionByName(other)
    return both.groupBy("activity_date", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _periods(grain: str) -> tuple[Column, str]:
    return {
        "day": (F.col("activity_date").alias("activity_date"), "dau"),
        "week": (week_start("activity_date").alias("week_start"), "wau"),
        "month": (month_start("activity_date").alias("activity_month"), "mau"),
    }[grain]


def active_from_days(days: DataFrame, grain: str) -> DataFrame:
    """``active_users`` of each day, week or month, from a day table."""
    period, alias = _periods(grain)
    name = period._jc.toString().split(" AS ")[-1]
    blocks = days.groupBy(period, "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return blocks.groupBy(name).agg(F.coalesce(F.sum(F.when(F.col("block").isNotNull(), F.bitmap_count("bits"))), F.lit(0)).cast("long").alias(alias))


def day_sketches(events: DataFrame, *, user: str = "user_id", time: str = "event_time", bits: int = SKETCH_BITS) -> DataFrame:
    """``activity_date, sketch``."""
    return events.groupBy(F.to_date(time).alias("activity_date")).agg(F.hll_sketch_agg(user, F.lit(bits)).alias("sketch"))


def estimated_from_days(sketches: DataFrame, grain: str) -> DataFrame:
    """Estimates of ``active_users`` of each day, week or month, from daily sketches."""
    period, alias = _periods(grain)
    return sketches.groupBy(period).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(alias))


def monthly_growth(months: DataFrame) -> DataFrame:
    """``activity_month, month_label, mau, mau_diff, mau_growth_pct`` from ``active_from_days(days, "month")``."""
    from .activity import growth

    return growth(months.select("activity_month", month_label("activity_month").alias("month_label"), "mau"), "mau", "activity_month")
