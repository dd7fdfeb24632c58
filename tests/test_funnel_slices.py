"""One-scan funnel: equal to the step-by-step funnel, split by time, appendable."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eventscope.operators import funnel_from_slices, funnel_sessions, funnel_slices

STEPS = ("view", "cart", "purchase")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("slice_seconds", [1, 60, 3600, 10**9])
def test_fixture_sessions(session_events, slice_seconds):
    sliced = funnel_from_slices(funnel_slices(session_events, slice_seconds=slice_seconds))
    plain = funnel_sessions(session_events)
    assert sliced.dtypes == plain.dtypes and rows_of(sliced.na.fill("")) == rows_of(plain.na.fill(""))


@pytest.mark.parametrize("steps", [("a", "b"), ("a", "b", "c"), ("a", "b", "a", "c"), ("c", "c", "b", "a")])
def test_random_logs_with_ties(spark, steps):
    rnd = random.Random(len(steps))
    start = dt.datetime(1969, 12, 31, 23, 59, 50)  # slices on both sides of 1970
    rows = [
        (None if rnd.random() < 0.03 else start + dt.timedelta(milliseconds=500 * rnd.randint(0, 60)), rnd.choice("abcd"), rnd.choice([None, *range(40)]))
        for _ in range(2500)
    ]
    events = spark.createDataFrame(rows, "event_time timestamp, event_type string, user_session int").repartition(5)
    key = lambda df: {r[0]: tuple(r)[1:] for r in df.collect()}
    want = key(funnel_sessions(events, steps, names=names(steps)))
    for width in (1, 2, 7, 1000):
        assert key(funnel_from_slices(funnel_slices(events, steps, slice_seconds=width), steps, names=names(steps))) == want


def names(steps):
    from eventscope.operators import StepNames

    return StepNames(tuple(f"r{i}" for i in range(len(steps))), tuple(f"t{i}" for i in range(len(steps))), steps)


def test_appended_slices_equal_a_full_run(spark, tmp_path):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=rnd.randint(0, 200)), rnd.choice(STEPS), rnd.randint(0, 30)) for _ in range(900)]
    events = spark.createDataFrame(rows, "event_time timestamp, event_type string, user_session int")
    table = str(tmp_path / "slices")
    for a, b in ((0, 50), (50, 120), (120, 999)):
        part = events.where(F.col("event_time").between(F.lit(start + dt.timedelta(seconds=a)), F.lit(start + dt.timedelta(seconds=b) - dt.timedelta(microseconds=1))))
        funnel_slices(part, slice_seconds=10).write.mode("append").parquet(table)
    assert rows_of(funnel_from_slices(spark.read.parquet(table)).na.fill({"user_session": 0})) == rows_of(funnel_sessions(events))


def test_one_scan_and_a_hot_session_in_many_groups(spark, tmp_path):
    path = str(tmp_path / "events")
    hot = spark.range(20_000).select(
        F.timestamp_seconds(F.col("id") * 30).alias("event_time"),
        F.element_at(F.array(*[F.lit(s) for s in STEPS]), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("user_session"),
    )
    hot.write.parquet(path)
    events = spark.read.parquet(path)
    slices = funnel_slices(events)
    sliced = funnel_from_slices(slices)
    plan = sliced._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Scan parquet") == 1 and "hashpartitioning(user_session" in plan and "slice" in plan
    per_group = slices.where("user_session = 'hot'").count()
    assert per_group == -(-20_000 * 30 // 3600)  # one group per hour, none with more than an hour's events
    key = lambda df: {r[0]: tuple(r)[1:] for r in df.collect()}
    assert key(sliced) == key(funnel_sessions(events))


def test_empty_and_wrong_input(session_events):
    assert funnel_from_slices(funnel_slices(session_events.where("event_type = 'none'"))).collect() == []
    with pytest.raises(ValueError):
        funnel_slices(session_events, ("view",))
    with pytest.raises(ValueError):
        funnel_slices(session_events, slice_seconds=0)
