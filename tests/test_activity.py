"""Activity metrics: calendar rules, moving average over rows, growth, sticky factor."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from eventscope.functions.exprs import iso_day_of_week, iso_week, iso_year, week_start
from eventscope.operators import daily_report, growth, monthly_report, weekly_report
from eventscope.operators.activity import ENGLISH_DAY_TYPE_LABELS

from .conftest import as_dicts, events_df


def test_iso_calendar(spark):
    r = spark.range(1).select(
        F.lit(dt.date(2021, 1, 3)).alias("d")
    ).select(
        iso_day_of_week("d").alias("dow"), iso_year("d").alias("y"), iso_week("d").alias("w"), week_start("d").alias("ws")
    ).first()
    assert (r["dow"], r["y"], r["w"], r["ws"]) == (7, 2020, 53, dt.date(2020, 12, 28))


def _daily_events(spark, days_users):
    rows = []
    for day, users in days_users.items():
        for u in users:
            rows.append((dt.datetime(2024, 1, day, 9), "view", 1, u, f"{u}-{day}"))
            rows.append((dt.datetime(2024, 1, day, 10), "view", 1, u, f"{u}-{day}"))
    return events_df(spark, rows)


def test_moving_average_is_by_rows_and_skips_missing_days(spark):
    # Jan 1..8 with Jan 4 missing: the 7-row frame on Jan 8 still reaches Jan 1
    # (a 7-day range frame would not): 16/7 -> 2, not 6/6 -> 1.
    days = {1: list(range(10)), 2: [1], 3: [1], 5: [1], 6: [1], 7: [1], 8: [1]}
    out = as_dicts(daily_report(_daily_events(spark, days), ENGLISH_DAY_TYPE_LABELS))
    assert [r["dau"] for r in out] == [10, 1, 1, 1, 1, 1, 1]
    # partial frames at the start; ties round half away from zero: 11/2 -> 6, 15/6 -> 3
    assert [r["dau_7d_moving_avg"] for r in out] == [Decimal(x) for x in ("10", "6", "4", "3", "3", "3", "2")]
    assert [r["day_type"] for r in out][:2] == ["weekday", "weekday"]
    assert out[4]["day_of_week"] == 6 and out[5]["day_of_week"] == 7  # 2024-01-06/07: Saturday, Sunday
    assert out[5]["day_type"] == "weekend" and out[6]["day_type"] == "weekday"


def test_default_day_labels_are_published_ones(spark):
    out = as_dicts(daily_report(_daily_events(spark, {6: [1], 8: [1]})))
    assert [r["day_type"] for r in out] == ["Выходной", "Будний день"]




def test_growth_matches_published_mom(spark):
    mau = spark.createDataFrame(
        [(dt.date(2020, 10, 1), 84216), (dt.date(2020, 11, 1), 92600), (dt.date(2020, 12, 1), 72137),
         (dt.date(2021, 1, 1), 81256), (dt.date(2021, 2, 1), 74606)],
        "m date, mau long",
    )
    out = as_dicts(growth(mau, "mau", "m", digits=1).orderBy("m"))
    assert [r["mau_growth_pct"] for r in out] == [None, Decimal("10.0"), Decimal("-22.1"), Decimal("12.6"), Decimal("-8.2")]
    assert out[1]["mau_diff"] == 8384


def test_growth_zero_previous_period_is_null(spark):
    # week 1 has events from unknown users only: WAU 0, so week 2's growth is NULL
    rows = [(dt.datetime(2024, 1, 1, 9), "view", 1, None, "s1"), (dt.datetime(2024, 1, 8, 9), "view", 1, 5, "s2")]
    out = as_dicts(weekly_report(events_df(spark, rows)))
    assert [r["wau"] for r in out] == [0, 1]
    assert out[1]["wau_diff"] == 1 and out[1]["wau_growth_pct"] is None


def test_monthly_sticky_uses_rounded_avg_dau(spark):
    # January: DAU 1, 2 -> avg 1.5 -> rounded 2; MAU 2 -> sticky 100.00 (not 75.00)
    days = {1: [1], 2: [1, 2]}
    out = as_dicts(monthly_report(_daily_events(spark, days)))
    r = out[0]
    assert (r["mau"], r["avg_dau"], r["min_dau"], r["max_dau"]) == (2, Decimal("2"), 1, 2)
    assert r["sticky_factor_pct"] == Decimal("100.00")
    assert r["sessions_per_user"] == Decimal("1.50") and r["events_per_user"] == Decimal("3.00")
    assert r["mau_diff"] is None and r["mau_growth_pct"] is None


def test_monthly_invariants_on_orders(spark):
    from eventscope.operators import active_users
    from eventscope.sources import order_events, read_table

    from .conftest import SF001

    ev = order_events(read_table(spark, SF001, "orders"))
    report = monthly_report(ev)
    daily = active_users(ev, "day").groupBy(F.trunc("activity_date", "month").alias("activity_month")).agg(
        F.sum("dau").alias("sum_dau")
    )
    bad = report.join(daily, "activity_month").where("NOT (max_dau <= mau AND mau <= sum_dau)")
    assert bad.count() == 0


def test_exclude_partial_months(spark):
    rows = [(dt.datetime(2024, 1, 20, 9), "view", 1, 1, "a"), (dt.datetime(2024, 2, 1, 9), "view", 1, 1, "b"),
            (dt.datetime(2024, 2, 29, 9), "view", 1, 2, "c"), (dt.datetime(2024, 3, 2, 9), "view", 1, 2, "d")]
    out = as_dicts(monthly_report(events_df(spark, rows), exclude_partial=True))
    assert [r["month_label"] for r in out] == ["2024-02"]


def test_fill_missing_days_and_weeks(spark):
    days = {1: list(range(10)), 2: [1], 3: [1], 5: [1], 6: [1], 7: [1], 8: [1]}
    ev = _daily_events(spark, days)
    out = as_dicts(daily_report(ev, fill_missing_days=True))
    assert [r["activity_date"].day for r in out] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert out[3]["dau"] == 0
    # calendar frame on Jan 8: Jan 2..8 -> 6 / 7 -> 1 (the literal row frame gives 2)
    assert out[-1]["dau_7d_moving_avg"] == Decimal("1")
    rows = [(dt.datetime(2024, 1, 1, 9), "view", 1, 1, "a"), (dt.datetime(2024, 1, 22, 9), "view", 1, 2, "b")]
    weeks = as_dicts(weekly_report(events_df(spark, rows), fill_missing_weeks=True))
    assert [r["wau"] for r in weeks] == [1, 0, 0, 1]
    assert weeks[-1]["wau_growth_pct"] is None and weeks[1]["wau_growth_pct"] == Decimal("-100.00")


def test_approximate_distinct_counts_are_close(spark):
    from eventscope.operators import profile_volume
    from eventscope.sources import order_events, read_table

    from .conftest import SF001

    ev = order_events(read_table(spark, SF001, "orders"))
    exact = {r["activity_month"]: r["mau"] for r in monthly_report(ev).collect()}
    approx = {r["activity_month"]: r["mau"] for r in monthly_report(ev, approx_rsd=0.01).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(approx[m] - exact[m]) <= max(3, 0.05 * exact[m]) for m in exact)
    v, a = profile_volume(ev).first(), profile_volume(ev, approx_rsd=0.01).first()
    assert abs(a["unique_users"] - v["unique_users"]) <= 0.05 * v["unique_users"]
    assert a["total_events"] == v["total_events"]


def test_null_periods_come_last(spark):
    rows = [(dt.datetime(2024, 1, d), "view", 1, u, "s") for d, u in [(1, 1), (2, 1), (2, 2), (9, 1)]] + [(None, "view", 1, u, "s") for u in range(5)]
    events = events_df(spark, rows)
    daily = [(r["activity_date"], r["dau"], r["dau_7d_moving_avg"]) for r in as_dicts(daily_report(events))]
    assert daily == [(dt.date(2024, 1, 1), 1, 1), (dt.date(2024, 1, 2), 2, 2), (dt.date(2024, 1, 9), 1, 1), (None, 5, 2)]
    weekly = [(r["week_start"], r["wau"], r["wau_diff"], r["wau_growth_pct"]) for r in as_dicts(weekly_report(events))]
    assert weekly == [(dt.date(2024, 1, 1), 2, None, None), (dt.date(2024, 1, 8), 1, -1, Decimal("-50.00")), (None, 5, 4, Decimal("400.00"))]
    filled = [(r["activity_date"], r["dau"]) for r in as_dicts(daily_report(events, fill_missing_days=True))]
    assert len(filled) == 10 and filled[-1] == (None, 5) and filled[4] == (dt.date(2024, 1, 5), 0)


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_reports_read_the_events_once(spark, tmp_path, session_events):
    from eventscope.operators import profile_volume

    session_events.write.parquet(str(tmp_path / "ev"))
    events = spark.read.parquet(str(tmp_path / "ev"))
    for report in (monthly_report(events), daily_report(events, fill_missing_days=True), profile_volume(events)):
        assert _final_plan(report).count("FileScan parquet") == 1
    # distinct counts copy rows only after the first aggregate
    plan = _final_plan(profile_volume(events))
    assert plan.index("Expand") < plan.index("HashAggregate", plan.index("Expand")) < plan.index("FileScan")
