"""Active users: daily, weekly and monthly actives, moving average, stickiness, growth.

Every level is its own distinct count (a user active ten days is ten in the sum
of DAU but one in MAU). Distinct counts run as Spark's two-level aggregate
(partial per task on ``(period, user)``, then per period), so a hot user or a hot
day never meets in one task as raw rows; the monthly report takes all its levels
from one count per day, user and session.

Windows without a partition (moving average, period-over-period growth) only
ever run on the aggregated periods -- at most one row per calendar day -- never
on events. Frames are by rows and ``lag`` is by row: by default missing
periods are not filled in (``fill_missing_days`` / ``fill_missing_weeks`` add them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (
    distinct_count,
    iso_day_of_week,
    iso_week,
    iso_year,
    month_label,
    month_start,
    pct,
    ratio,
    week_start,
)

# Day-type labels of the published report.
DAY_TYPE_LABELS = {"weekend": "Выходной", "weekday": "Будний день"}
ENGLISH_DAY_TYPE_LABELS = {"weekend": "weekend", "weekday": "weekday"}


def active_users(
    events: DataFrame,
    grain: str = "day",
    *,
    user: str = "user_id",
    time: str = "event_time",
    alias: str | None = None,
    approx_rsd: float | None = None,
) -> DataFrame:
    """Distinct non-NULL users per day / week (Monday start) / month.

    Columns: ``activity_date, dau`` | ``week_start, wau`` | ``activity_month, mau``.
    """
    period, default_alias = {
        "day": (F.to_date(F.col(time)).alias("activity_date"), "dau"),
        "week": (week_start(time).alias("week_start"), "wau"),
        "month": (month_start(time).alias("activity_month"), "mau"),
    }[grain]
    return events.groupBy(period).agg(distinct_count(user, approx_rsd).alias(alias or default_alias))


def growth(df: DataFrame, metric: str, order: str, digits: int = 2) -> DataFrame:
    """Add ``<metric>_diff = x - lag(x)`` and ``<metric>_growth_pct`` (NULL on the first row
    and when the previous value is 0). Use on aggregated periods only."""
    prev = F.lag(F.col(metric)).over(Window.orderBy(F.col(order).asc_nulls_last()))
    return df.withColumn(f"{metric}_diff", F.col(metric) - prev).withColumn(
        f"{metric}_growth_pct", pct(F.col(metric) - prev, prev, digits)
    )


def densify(periods: DataFrame, period: str, metric: str, step: str) -> DataFrame:
    """Add the missing periods between the first and last one with ``metric = 0``.

    Each row is followed by the periods up to the next row (``lead`` over the
    aggregated periods), so the input is read once. A NULL period stays one row.
    """
    following = F.lead(period).over(Window.orderBy(F.col(period).asc_nulls_last()))
    days = {"DAY": 1, "WEEK": 7}[step]
    last = F.coalesce(F.date_sub(following, days), F.col(period))
    run = F.sequence(F.col(period), last, F.expr(f"INTERVAL {days} DAY"))
    filled = periods.withColumn("_run", F.when(F.col(period).isNull(), F.array(F.col(period))).otherwise(run))
    return filled.select(F.explode("_run").alias("_p"), period, metric).select(
        F.col("_p").alias(period), F.when(F.col("_p") == F.col(period), F.col(metric)).when(F.col("_p").isNull(), F.col(metric)).otherwise(F.lit(0)).cast("bigint").alias(metric)
    )


def daily_report(
    events: DataFrame,
    weekend_labels: dict[str, str] | None = None,
    *,
    user: str = "user_id",
    time: str = "event_time",
    window_days: int = 7,
    fill_missing_days: bool = False,
    approx_rsd: float | None = None,
) -> DataFrame:
    """``activity_date, dau, dau_7d_moving_avg, day_of_week, day_type`` by date.

    The moving average is over the current and previous ``window_days - 1``
    *rows* (days with activity), rounded to an integer; early rows use a shorter
    frame. ``fill_missing_days=True`` first adds days without activity (DAU 0),
    making the frame a true calendar window.
    """
    labels = weekend_labels or DAY_TYPE_LABELS
    daily = active_users(events, "day", user=user, time=time, approx_rsd=approx_rsd)
    if fill_missing_days:
        daily = densify(daily, "activity_date", "dau", "DAY")
    frame = Window.orderBy(F.col("activity_date").asc_nulls_last()).rowsBetween(-(window_days - 1), Window.currentRow)
    dow = iso_day_of_week("activity_date")
    return daily.select(
        "activity_date",
        "dau",
        _mean_over(F.col("dau"), frame, 0).alias("dau_7d_moving_avg" if window_days == 7 else f"dau_{window_days}d_moving_avg"),
        dow.alias("day_of_week"),
        F.when(dow.isin(6, 7), F.lit(labels["weekend"])).otherwise(F.lit(labels["weekday"])).alias("day_type"),
    ).orderBy(F.col("activity_date").asc_nulls_last())


def weekly_report(
    events: DataFrame,
    *,
    user: str = "user_id",
    time: str = "event_time",
    fill_missing_weeks: bool = False,
    approx_rsd: float | None = None,
) -> DataFrame:
    """``week_start, iso_year, iso_week, wau, wau_diff, wau_growth_pct`` (week over week).

    Growth compares with the previous *row*; ``fill_missing_weeks=True`` adds
    weeks without activity (WAU 0) so it always compares with the previous week.
    """
    weekly = active_users(events, "week", user=user, time=time, approx_rsd=approx_rsd)
    if fill_missing_weeks:
        weekly = densify(weekly, "week_start", "wau", "WEEK")
    weekly = weekly.select(
        "week_start", iso_year("week_start").alias("iso_year"), iso_week("week_start").alias("iso_week"), "wau"
    )
    return growth(weekly, "wau", "week_start").orderBy(F.col("week_start").asc_nulls_last())


def monthly_report(
    events: DataFrame,
    *,
    user: str = "user_id",
    session: str = "user_session",
    time: str = "event_time",
    exclude_partial: bool = False,
    approx_rsd: float | None = None,
) -> DataFrame:
    """Monthly actives, stickiness and intensity.

    Columns: ``activity_month, month_label, mau, avg_dau, min_dau, max_dau,
    sticky_factor_pct, sessions_per_user, events_per_user, mau_diff, mau_growth_pct``.
    ``avg_dau`` is rounded to an integer first and the sticky factor
    (``100 * avg_dau / mau``) uses the rounded value.

    ``exclude_partial`` drops the first and last month when the data does not
    start on the 1st / end on the last day of the month (growth is then
    computed over full months only).

    Distinct counts are exact; ``approx_rsd`` (e.g. ``0.01``) switches every
    distinct count of the report (DAU, MAU, sessions) to HyperLogLog++ estimates.
    """
    # One pass over the events: counts per day, user and session (combined on the
    # map side, so hot users and days collapse). Both levels below read this
    # exchange; they use the same columns of it, which lets Spark compute it once.
    base = events.groupBy(F.to_date(F.col(time)).alias("_day"), F.col(user).alias("_user"), F.col(session).alias("_session")).agg(
        F.count(F.lit(1)).alias("_events")
    )
    monthly = base.groupBy(F.trunc("_day", "month").alias("activity_month")).agg(
        distinct_count("_user", approx_rsd).alias("mau"),
        distinct_count("_session", approx_rsd).alias("sessions"),
        F.sum("_events").alias("events_total"),
        F.min("_day").alias("_first_day"),
        F.max("_day").alias("_last_day"),
    )
    daily = base.groupBy(F.col("_day").alias("activity_date")).agg(
        distinct_count("_user", approx_rsd).alias("dau"), F.sum("_events").alias("_events"), F.count("_session").alias("_sessions")
    )
    per_month = daily.groupBy(F.trunc("activity_date", "month").alias("_month")).agg(
        F.round(F.sum("dau").cast("decimal(20,0)") / F.count("dau"), 0).alias("avg_dau"),
        F.min("dau").alias("min_dau"),
        F.max("dau").alias("max_dau"),
        F.sum("_events").alias("_events_of_days"), F.sum("_sessions").alias("_sessions_of_days"),
    )
    # Both sides are one row per month: AQE broadcasts whichever is small. The
    # totals of both levels are the same counts, added up in two ways: a month in
    # which they differ stops the report.
    same = (F.col("events_total") == F.col("_events_of_days")) & (F.col("_sessions_of_days") >= 0)
    differ = F.raise_error(F.concat(F.lit("the days of a month do not add up to it: "), F.col("activity_month").cast("string"))).cast("bigint")
    joined = monthly.join(per_month, F.col("activity_month") == F.col("_month")).withColumn(
        "events_total", F.when(same, F.col("events_total")).otherwise(differ)
    )
    if exclude_partial:
        joined = _drop_partial_months(joined)
    report = joined.select(
        "activity_month",
        month_label("activity_month").alias("month_label"),
        "mau",
        "avg_dau",
        "min_dau",
        "max_dau",
        pct("avg_dau", "mau").alias("sticky_factor_pct"),
        ratio("sessions", "mau").alias("sessions_per_user"),
        ratio("events_total", "mau").alias("events_per_user"),
    )
    return growth(report, "mau", "activity_month").orderBy(F.col("activity_month").asc_nulls_last())


def _mean_over(c: Column, frame: Window, digits: int) -> Column:
    """Exact decimal mean over a window frame, rounded half away from zero."""
    return F.round(F.sum(c).over(frame).cast("decimal(20,0)") / F.count(c).over(frame), digits)


def _drop_partial_months(monthly: DataFrame) -> DataFrame:
    # one row per month: the unpartitioned window is over months, not events
    everything = Window.partitionBy()
    bounds = monthly.withColumn("_data_first", F.min("activity_month").over(everything)).withColumn(
        "_data_last", F.max("activity_month").over(everything)
    )
    starts_late = (F.col("activity_month") == F.col("_data_first")) & (F.dayofmonth("_first_day") != 1)
    ends_early = (F.col("activity_month") == F.col("_data_last")) & (F.col("_last_day") != F.last_day("_last_day"))
    return bounds.where(~(starts_late | ends_early)).drop("_data_first", "_data_last")


__all__ = [
    "DAY_TYPE_LABELS",
    "ENGLISH_DAY_TYPE_LABELS",
    "active_users",
    "daily_report",
    "densify",
    "growth",
    "monthly_report",
    "weekly_report",
]
