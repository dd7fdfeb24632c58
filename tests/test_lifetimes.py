"""Bit-set lives against the cohort activity table, merged in parts."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eventscope.operators import (
    cells_from_months, cohort_activity, cohort_cells, lifetimes, merge_months, retention_curve, retention_long, retention_matrix, user_months,
)


def random_events(spark, seed, users=60, months=150, start=2019 * 12 + 7):
    rnd = random.Random(seed)
    rows = []
    for _ in range(900):
        m = start + int(months * rnd.random() ** 2)
        time = None if rnd.random() < 0.04 else dt.datetime(m // 12, m % 12 + 1, rnd.randint(1, 28), rnd.randint(0, 23))
        rows.append((time, None if rnd.random() < 0.05 else rnd.randint(0, users)))
    rows += [(None, 777), (dt.datetime(2033, 1, 1), None)]
    return spark.createDataFrame(rows, "event_time timestamp, user_id int").repartition(4)


def key(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_equal_those_of_the_activity_table(spark, seed):
    events = random_events(spark, seed)
    got, want = cells_from_months(user_months(events)), cohort_cells(cohort_activity(events))
    assert got.columns == want.columns and key(got) == key(want)


def test_reports_from_cells(spark, cohort_events):
    cells, activity = cells_from_months(user_months(cohort_events)), cohort_activity(cohort_events)
    for report in (retention_matrix, retention_long, retention_curve):
        assert key(report(cells)) == key(report(activity))
    assert key(retention_matrix(cells, mask_unobserved=True)) == key(retention_matrix(activity, mask_unobserved=True))


def test_merged_parts_equal_a_full_run(spark, tmp_path):
    events = random_events(spark, 5)
    split = F.pmod(F.xxhash64("event_time", "user_id"), F.lit(3))
    path = str(tmp_path / "state")
    user_months(events.where(split == 0)).write.parquet(path)
    merged = merge_months(spark.read.parquet(path), user_months(events.where(split == 1)), user_months(events.where(split != 0)))
    assert key(cells_from_months(merged)) == key(cohort_cells(cohort_activity(events)))


def test_lives_across_words(spark):
    months = [0, 59, 60, 119, 120, 24_239, 24_240]
    rows = [(m // 12, m % 12 + 1) for m in months if m >= 12]
    events = spark.createDataFrame([(dt.datetime(y, m, 1), 1) for y, m in rows] + [(None, 2)], "event_time timestamp, user_id int")
    got = {r.user_id: (r.first, r.last, len(r.life), r.timeless) for r in lifetimes(user_months(events)).collect()}
    assert got == {1: (59, 24_240, 5, False), 2: (None, None, 0, True)}


def test_empty(spark):
    events = spark.createDataFrame([], "event_time timestamp, user_id int")
    assert cells_from_months(user_months(events)).collect() == []
