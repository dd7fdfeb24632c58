"""Monthly cohort retention: matrices, long form with rolling retention, average curve.

The cohort is the month of a user's first event; ``month_num`` is the calendar
month difference between an active month and the cohort month.

Plan shape
----------
:func:`cohort_activity` first reduces events to distinct ``(user, month)``
pairs -- a partial aggregate, so a hot user collapses to at most one row per
month per task before the shuffle. A window by user over those pairs (at most
one row per calendar month per user) then gives the cohort and the last active
month without a self-join. Everything after that works on the cells table
(one row per cohort and month of life), which is bounded by the calendar
(months x months), not by the number of users or events.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.exprs import month_from_index, month_index, month_label, pct
from ..functions.staging import shared_folder, staged

WEIGHTINGS = ("cohort_size", "row_fanout")


def cohort_activity(events: DataFrame, *, user: str = "user_id", time: str = "event_time") -> DataFrame:
    """Distinct active months per user with cohort and lifespan.

    Columns: ``user_id, cohort_month (date), month_num, last_active_month,
    data_last_month (date)``. Users with a NULL id are dropped, but the last month
    of the data is that of *all* events, theirs included. A user's events without
    a time give a row with NULL ``month_num``; a user with no other events has a
    NULL cohort.
    """
    months = (
        events.where(F.col(user).isNotNull())
        .select(F.col(user).alias(user), month_index(time).alias("_m"))
        .distinct()
    )
    # one row, from a second read of the time column alone
    bound = events.agg(F.max(month_index(time)).alias("_data_last"))
    return _placed(months, user).crossJoin(F.broadcast(bound)).select(*_activity_columns(user), month_from_index("_data_last").alias("data_last_month"))


def _activity_columns(user: str) -> list[str]:
    return [user, "cohort_month", "month_num", "last_active_month"]


def _placed(months: DataFrame, user: str) -> DataFrame:
    """Distinct ``user, _m`` -> each month's place in its user's life."""
    by_user = Window.partitionBy(user)
    first = F.min("_m").over(by_user)
    last = F.max("_m").over(by_user)
    return months.select(
        user,
        month_from_index(first).alias("cohort_month"),
        (F.col("_m") - first).alias("month_num"),
        (last - first).alias("last_active_month"),
    )


def cohort_activity_observed(events: DataFrame, *, user: str = "user_id", time: str = "event_time") -> tuple[DataFrame, dict[str, Any]]:
    """:func:`cohort_activity` and the figures of the data, from one read of the events.

    The pass that reduces events to distinct ``(user, month)`` pairs, staged in the shared
    folder (which must be set), also observes ``total_events, first_day, last_day`` and the last month of
    all events, which becomes a constant of the plan. The job runs when the function is called. If Spark
    has to repeat tasks of the pass, ``total_events`` may count their rows again; ranges cannot change.
    """
    if shared_folder(events.sparkSession) is None:
        raise ValueError("set spark.checkpoint.dir to a folder on shared storage")
    seen = Observation()
    watched = events.select(F.col(user).alias(user), F.col(time).alias("_t"), month_index(time).alias("_m")).observe(
        seen, F.count(F.lit(1)).alias("total_events"), F.min(F.to_date("_t")).alias("first_day"), F.max(F.to_date("_t")).alias("last_day"),
        F.max("_m").alias("_last"),
    )
    months = staged(watched.where(F.col(user).isNotNull()).select(user, "_m").distinct())
    figures = dict(seen.get)
    last: Column = F.lit(figures.pop("_last")).cast("int")
    return _placed(months, user).select(*_activity_columns(user), month_from_index(last).alias("data_last_month")), figures


def cohort_cells(activity: DataFrame) -> DataFrame:
    """One row per non-empty (cohort, month of life).

    Columns: ``cohort_month, month_num, active_users, lapsed_users,
    data_last_month`` where ``lapsed_users`` counts users whose last active month
    is this one. The input is already distinct per (user, month), so plain
    counts suffice.
    """
    return activity.groupBy("cohort_month", "month_num").agg(
        F.count(F.lit(1)).alias("active_users"),
        F.count_if(F.col("month_num") == F.col("last_active_month")).alias("lapsed_users"),
        F.max("data_last_month").alias("data_last_month"),
    )


def _cells(table: DataFrame) -> DataFrame:
    """The cells of a cohort activity table; a table of cells is taken as it is."""
    return table if "lapsed_users" in table.columns else cohort_cells(table)


def cohort_sizes(cells: DataFrame, months: int = 0) -> DataFrame:
    """``cohort_month, total_users, max_observable_month`` per cohort.

    Every user is active in month 0 of their cohort, so the size is the month-0
    cell; users without any time form the NULL cohort, whose only cell is its
    size. The observable horizon is the last month of the data minus the cohort
    month. With ``months > 0`` the same aggregate also returns
    ``_a0 .. _a{months-1}``, the active users per month of life (NULL where nobody
    was active).
    """
    per_cohort = cells.groupBy("cohort_month").agg(
        F.expr("max(CASE WHEN month_num = 0 OR cohort_month IS NULL THEN active_users END)").alias("total_users"),
        F.max("data_last_month").alias("_data_last"),
        *[F.expr(f"max(CASE WHEN month_num = {k} THEN active_users END)").alias(f"_a{k}") for k in range(months)],
    )
    return per_cohort.select(
        "cohort_month", "total_users",
        (month_index("_data_last") - month_index("cohort_month")).alias("max_observable_month"),
        *[f"_a{k}" for k in range(months)],
    )


def retention_matrix(
    activity: DataFrame,
    months: int = 7,
    *,
    as_pct: bool = True,
    mask_unobserved: bool = False,
) -> DataFrame:
    """Cohort x month-of-life matrix, ``m0 .. m{months-1}``.

    ``months=7`` is the width of the published report (months 0 to 6), not a cap on
    the data: :func:`retention_long` has every month.

    ``as_pct=True`` (3.1): ``cohort_month, cohort, total_users, m0..`` with
    ``100 * active / size`` rounded to one digit; ``as_pct=False`` (3.2):
    ``cohort_month, cohort, m0_users..`` counts. Months nobody was active in
    give 0 (or ``0.0``), also when they lie beyond the data's last month;
    ``mask_unobserved=True`` gives NULL for months after the data ends.
    """
    # One aggregate per cohort gives the size, the horizon and every cell.
    joined = cohort_sizes(_cells(activity), months)

    def cell(k: int):
        active = f"coalesce(_a{k}, CAST(0 AS BIGINT))"
        value = f"round(100.0 * {active} / nullif(total_users, 0), 1)" if as_pct else active
        if mask_unobserved:
            value = f"CASE WHEN max_observable_month >= {k} THEN {value} END"
        return F.expr(value).alias(f"m{k}" if as_pct else f"m{k}_users")

    head = ["cohort_month", month_label("cohort_month").alias("cohort")]
    if as_pct:
        head.append("total_users")
    return joined.select(*head, *[cell(k) for k in range(months)]).orderBy(F.col("cohort_month").asc_nulls_last())


def retention_long(activity: DataFrame) -> DataFrame:
    """Tidy retention (3.3), one row per non-empty (cohort, month of life).

    Columns: ``cohort_month, cohort, total_users, month_num, active_users,
    retention_pct, rolling_retention_pct``. Rolling retention at N counts users
    whose last active month is N or later: a reverse running sum of
    ``lapsed_users`` within the cohort (each user's last month is itself a
    non-empty cell, so no month is missed). A cell of events without a time
    comes last in its cohort with rolling retention 0; the NULL cohort has no rows.
    """
    cells = _cells(activity).where(F.col("cohort_month").isNotNull())
    by_cohort = Window.partitionBy("cohort_month")
    later_first = by_cohort.orderBy(F.desc("month_num")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.max(F.when(F.col("month_num") == 0, F.col("active_users"))).over(by_cohort)
    staged = cells.select(
        "cohort_month", "month_num", "active_users",
        size.alias("total_users"),
        F.when(F.col("month_num").isNull(), F.lit(0)).otherwise(F.sum("lapsed_users").over(later_first)).alias("_still_active"),
    )
    return staged.select(
        "cohort_month",
        month_label("cohort_month").alias("cohort"),
        "total_users",
        "month_num",
        "active_users",
        pct("active_users", "total_users", 1).alias("retention_pct"),
        pct("_still_active", "total_users", 1).alias("rolling_retention_pct"),
    ).orderBy("cohort_month", F.col("month_num").asc_nulls_last())


def retention_curve(activity: DataFrame, weighting: str = "cohort_size") -> DataFrame:
    """Average retention by month of life over cohorts old enough to have it (3.4).

    Columns: ``month_num, cohorts_count, active_users, total_eligible_users,
    avg_retention_pct``.

    * ``"cohort_size"`` (default): every cohort whose observable horizon reaches
      N counts, with its full size, whether or not anyone returned:
      ``sum(active) / sum(size)``. Month 0 is always 100.
    * ``"row_fanout"``: the arithmetic of the published SQL, kept for parity --
      only cohorts with someone active at N count, and the denominator sums the
      cohort size once per *active user* (``sum(active * size)``).
    """
    if weighting not in WEIGHTINGS:
        raise ValueError(f"weighting must be one of {WEIGHTINGS}")
    cells = _cells(activity)
    sizes = cohort_sizes(cells)
    if weighting == "row_fanout":
        rows = cells.join(sizes, on="cohort_month").where(F.col("max_observable_month") >= F.col("month_num"))
        grouped = rows.groupBy("month_num").agg(
            F.count(F.lit(1)).alias("cohorts_count"),
            F.sum("active_users").alias("active_users"),
            # a product of two counts outgrows a bigint: summed as NUMERIC
            F.sum(F.col("active_users").cast("decimal(19,0)") * F.col("total_users").cast("decimal(19,0)")).alias("total_eligible_users"),
        )
    else:
        # cohort x (0 .. horizon) grid: at most cohorts x months rows.
        grid = sizes.select(
            "cohort_month", "total_users",
            F.explode(F.sequence(F.lit(0), F.col("max_observable_month"))).alias("month_num"),
        )
        rows = grid.join(cells.select("cohort_month", "month_num", "active_users"),
                         on=["cohort_month", "month_num"], how="left")
        grouped = rows.groupBy("month_num").agg(
            F.count(F.lit(1)).alias("cohorts_count"),
            F.coalesce(F.sum("active_users"), F.lit(0).cast("bigint")).alias("active_users"),
            F.sum("total_users").alias("total_eligible_users"),
        )
    return grouped.select(
        "month_num", "cohorts_count", "active_users", "total_eligible_users",
        pct("active_users", "total_eligible_users", 1).alias("avg_retention_pct"),
    ).orderBy("month_num")


__all__: Sequence[str] = [
    "WEIGHTINGS",
    "cohort_activity",
    "cohort_activity_observed",
    "cohort_cells",
    "cohort_sizes",
    "retention_curve",
    "retention_long",
    "retention_matrix",
]
