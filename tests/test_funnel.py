"""Ordered funnel on fixture 1 (FIXTURES.md) and on published totals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from eventscope.operators import StepNames, funnel_by_period, funnel_durations, funnel_sessions, funnel_steps, step_durations

from .conftest import as_dicts


def test_sessions_per_step(session_events):
    fs = funnel_sessions(session_events)
    rows = {r["user_session"]: r for r in as_dicts(fs)}
    assert sorted(rows) == list("ABCDEFIJM")
    assert sorted(k for k, r in rows.items() if r["carted_at"] is not None) == list("ACEIJM")
    assert sorted(k for k, r in rows.items() if r["purchased_at"] is not None) == list("AJ")


def test_steps_report(session_events):
    out = as_dicts(funnel_steps(funnel_sessions(session_events)).orderBy("step_no"))
    assert [(r["step_no"], r["step_name"], r["sessions"]) for r in out] == [(1, "View", 9), (2, "Cart", 6), (3, "Purchase", 2)]
    assert out[0]["micro_cr_pct"] is None and out[0]["sessions_lost"] is None
    assert out[1]["micro_cr_pct"] == Decimal("66.67") and out[1]["macro_cr_pct"] == Decimal("66.67")
    assert out[2]["micro_cr_pct"] == Decimal("33.33") and out[2]["macro_cr_pct"] == Decimal("22.22")
    assert out[2]["sessions_lost"] == 4 and out[2]["drop_off_pct"] == Decimal("66.67")


def test_monthly_by_entry_month(session_events):
    out = as_dicts(funnel_by_period(funnel_sessions(session_events)))
    assert len(out) == 1
    r = out[0]
    assert str(r["month"]) == "2024-01-01" and r["month_label"] == "2024-01"
    assert (r["sessions_view"], r["sessions_cart"], r["sessions_purchase"]) == (9, 6, 2)


def test_step_seconds_subsecond(session_events):
    d = {r["user_session"]: r for r in as_dicts(step_durations(funnel_sessions(session_events)))}
    assert {k: float(v["sec_view_to_cart"]) for k, v in d.items()} == {
        "A": 60.0, "C": 60.0, "E": 60.0, "I": 60.0, "J": 60.0, "M": 20.5
    }
    assert {k: float(v["sec_cart_to_purchase"]) for k, v in d.items() if v["sec_cart_to_purchase"] is not None} == {
        "A": 240.0, "J": 150.0
    }


def test_durations_row(session_events):
    r = as_dicts(funnel_durations(funnel_sessions(session_events)))[0]
    assert r["sessions_with_cart"] == 6 and r["sessions_with_purchase"] == 2
    assert float(r["median_sec_view_to_cart"]) == 60.0
    assert float(r["p90_sec_view_to_cart"]) == 60.0
    assert float(r["median_sec_cart_to_purchase"]) == 195.0
    assert float(r["p90_sec_cart_to_purchase"]) == 231.0
    assert float(r["median_sec_total"]) == 255.0


def test_published_conversion_arithmetic(spark):
    """488360 -> 41222 -> 20698 sessions give 8.44 / 50.21 micro and 8.44 / 4.24 macro."""
    ids = spark.range(488360)
    t = F.lit("2021-01-01 00:00:00").cast("timestamp")
    fs = ids.select(
        F.col("id").alias("user_session"),
        t.alias("viewed_at"),
        F.when(F.col("id") < 41222, t).alias("carted_at"),
        F.when(F.col("id") < 20698, t).alias("purchased_at"),
    )
    out = as_dicts(funnel_steps(fs).orderBy("step_no"))
    assert [r["sessions"] for r in out] == [488360, 41222, 20698]
    assert [r["micro_cr_pct"] for r in out] == [None, Decimal("8.44"), Decimal("50.21")]
    assert [r["macro_cr_pct"] for r in out] == [Decimal("100.00"), Decimal("8.44"), Decimal("4.24")]
    assert out[1]["sessions_lost"] == 447138 and out[1]["drop_off_pct"] == Decimal("91.56")


def test_n_step_funnel_and_empty(session_events):
    two = funnel_sessions(session_events, ("view", "purchase"))
    rows = {r["user_session"]: r for r in as_dicts(two)}
    # purchase strictly after the first view (no cart needed in a two-step funnel)
    assert sorted(k for k, r in rows.items() if r["purchase_at"] is not None) == ["A", "E", "F", "J"]
    empty = funnel_sessions(session_events.where("false"))
    assert empty.count() == 0
    totals = as_dicts(funnel_steps(empty))
    assert [r["sessions"] for r in totals] == [0, 0, 0]
    assert all(r["macro_cr_pct"] is None for r in totals)


def test_plan_has_no_window_and_pushes_filters(session_events, tmp_path, spark):
    path = str(tmp_path / "ev")
    session_events.write.parquet(path)
    plan = funnel_steps(funnel_sessions(spark.read.parquet(path)))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "EqualTo(event_type,view)" in plan and "IsNotNull(user_session)" in plan


def test_two_step_durations(session_events):
    fs = funnel_sessions(session_events, ("view", "purchase"))
    names = StepNames.of(("view", "purchase"))
    r = as_dicts(funnel_durations(fs, names=names))[0]
    # A 300 s, E 60 s, F 60 s, J 210 s
    assert r == {"sessions_with_purchase": 4, "median_sec_view_to_purchase": Decimal("135.0"),
                 "p90_sec_view_to_purchase": Decimal("273.0"), "median_sec_total": Decimal("135.0")}
    assert [x["step_name"] for x in as_dicts(funnel_steps(fs, names=names))] == ["view", "purchase"]


def test_names_follow_the_steps_and_extra_columns_do_not_matter(session_events):
    steps = ("view", "cart", "remove_from_cart")
    names = StepNames.of(steps)
    fs = funnel_sessions(session_events, steps).withColumn("loaded_at", F.lit("x"))
    assert list(names.times) == ["view_at", "cart_at", "remove_from_cart_at"]
    out = as_dicts(funnel_steps(fs, names=names))
    assert [(r["step_name"], r["sessions"]) for r in out] == [("view", 9), ("cart", 6), ("remove_from_cart", 2)]
    own = StepNames(("a", "b", "c"), ("t1", "t2", "t3"), ("A", "B", "C"))
    renamed = funnel_by_period(funnel_sessions(session_events, steps, names=own), names=own)
    assert "cr_a_to_b_pct" in renamed.columns and "sessions_c" in renamed.columns


def test_events_with_unknown_time_are_ignored(spark):
    from .conftest import events_df, ts

    ev = events_df(spark, [(None, "view", 1, 1, "x"), (ts("01-10", "10:00"), "view", 1, 2, "y"),
                           (ts("01-10", "10:01"), "cart", 1, 2, "y"), (None, "purchase", 1, 2, "y")])
    fs = funnel_sessions(ev)
    assert [r["user_session"] for r in as_dicts(fs)] == ["y"]
    assert [r["sessions"] for r in as_dicts(funnel_steps(fs).orderBy("step_no"))] == [1, 1, 0]


def test_step_tables_are_scanned_once(session_events, tmp_path, spark):
    path = str(tmp_path / "ev")
    session_events.write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = funnel_steps(funnel_sessions(spark.read.parquet(path)))
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one scan per step; the step tables feeding two consumers are reused exchanges
    assert final.count("FileScan parquet") == 3, final
    assert final.count("SortMergeJoin") == 2


def test_durations_custom_levels(session_events):
    r = as_dicts(funnel_durations(funnel_sessions(session_events), probs=(0.25, 0.99)))[0]
    # cart -> purchase gaps: 150, 240
    assert r["p25_sec_cart_to_purchase"] == Decimal("172.5") and r["p99_sec_cart_to_purchase"] == Decimal("239.1")
    assert "median_sec_view_to_cart" not in r and r["median_sec_total"] == Decimal("255.0")


def test_durations_reuse_the_funnel(session_events, tmp_path, spark):
    path = str(tmp_path / "ev")
    session_events.write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = funnel_durations(funnel_sessions(spark.read.parquet(path)))
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the funnel ran once, into the staged durations: no round of the percentiles reads the events
    assert final.count("FileScan parquet") == 1 and path not in final


def test_funnel_by_week_and_day(session_events):
    fs = funnel_sessions(session_events)
    weeks = as_dicts(funnel_by_period(fs, "week"))
    # 2024-01-10 is in the week of Monday 01-08; session M entered on Wednesday 01-31 (week of 01-29)
    assert [(str(r["week"]), r["week_label"], r["sessions_view"], r["sessions_cart"]) for r in weeks] == [
        ("2024-01-08", "2024-01-08", 8, 5, ), ("2024-01-29", "2024-01-29", 1, 1)
    ]
    days = as_dicts(funnel_by_period(fs, "day"))
    assert [(r["day_label"], r["sessions_view"], r["sessions_purchase"]) for r in days] == [("2024-01-10", 8, 2), ("2024-01-31", 1, 0)]
