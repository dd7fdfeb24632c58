"""Day bitmaps and sketches against the exact reports."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eventscope.operators import (
    active_from_days, active_users, add_users, day_bitmaps, day_sketches, estimated_from_days, merge_days, number_users,
)


@pytest.fixture
def events(spark):
    rnd = random.Random(4)
    rows = [
        (None if rnd.random() < 0.02 else dt.datetime(2023, 12, 28) + dt.timedelta(hours=rnd.randint(0, 24 * 70)), rnd.choice([None, -5, 10**15, *range(200)]))
        for _ in range(3000)
    ]
    rows.append((dt.datetime(2024, 6, 1), None))  # a day of unknown users alone
    return spark.createDataFrame(rows, "event_time timestamp, user_id long").repartition(4)


def key(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("grain", ["day", "week", "month"])
def test_rolled_up_days_equal_the_exact_report(events, grain):
    days = day_bitmaps(events, number_users(events))
    got, want = active_from_days(days, grain), active_users(events, grain)
    assert got.columns == want.columns and key(got) == key(want)


def test_days_are_appended_and_merged(spark, events, tmp_path):
    early, late = events.where("event_time < '2024-02-03'"), events.where("event_time >= '2024-02-03' OR event_time IS NULL")
    numbers = number_users(early)
    numbers.write.parquet(str(tmp_path / "numbers"))
    numbers = spark.read.parquet(str(tmp_path / "numbers"))
    more = add_users(numbers, late)
    assert sorted(r.number for r in more.collect()) == list(range(more.count()))
    assert set(map(tuple, numbers.collect())) <= set(map(tuple, more.collect()))
    # one day arrives in two parts
    half = F.pmod(F.xxhash64("user_id"), F.lit(2)) == 0
    parts = [day_bitmaps(early, numbers), day_bitmaps(late.where(half), more), day_bitmaps(late.where(~half | half.isNull()), more)]
    for grain in ("day", "week", "month"):
        assert key(active_from_days(merge_days(*parts), grain)) == key(active_users(events, grain))


def test_numbers_beyond_one_block(spark):
    events = spark.range(0, 70_000, 1, 5).select(F.lit(dt.datetime(2024, 1, 1)).alias("event_time"), (F.col("id") * 1_000_003).alias("user_id"))
    numbers = number_users(events)
    assert numbers.agg(F.min("number"), F.max("number"), F.countDistinct("number")).first()[:] == (0, 69_999, 70_000)
    days = day_bitmaps(events, numbers)
    assert days.count() == 3 and active_from_days(days, "month").first().mau == 70_000


def test_sketch_error_is_measured(spark):
    rows = spark.range(0, 60_000, 1, 5).select(
        F.expr("date_add(date '2024-01-01', cast(id % 40 as int))").cast("timestamp").alias("event_time"), (F.col("id") % 23_000).alias("user_id")
    )
    days = day_sketches(rows)
    for grain, name in (("day", "dau"), ("week", "wau"), ("month", "mau")):
        exact = {r[0]: r[1] for r in active_users(rows, grain).collect()}
        for r in estimated_from_days(days, grain).collect():
            assert abs(r[name] - exact[r[0]]) <= 0.07 * exact[r[0]]  # four standard deviations


def test_empty(spark):
    none = spark.createDataFrame([], "event_time timestamp, user_id long")
    days = day_bitmaps(none, number_users(none))
    assert active_from_days(days, "week").collect() == [] and estimated_from_days(day_sketches(none), "day").collect() == []
