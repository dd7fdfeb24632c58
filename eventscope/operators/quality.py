"""Sanity profile of an event table: volume and range, event-type split, NULL counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import distinct_count, month_start, pct

DEFAULT_NULL_COLUMNS = ("user_id", "user_session", "brand", "category_code", "price")


def profile_volume(
    events: DataFrame,
    *,
    user: str = "user_id",
    session: str = "user_session",
    time: str = "event_time",
    approx_rsd: float | None = None,
) -> DataFrame:
    """One row: ``total_events, unique_users, unique_sessions, first_day, last_day, months_covered``.

    An empty input still returns one row (counts 0, days NULL). ``approx_rsd``
    estimates the user and session counts with HyperLogLog++ instead.
    """
    # Counts per user, session and month first (combined on the map side): the
    # three distinct counts then work on these rows, not on the events.
    base = events.groupBy(F.col(user).alias("_user"), F.col(session).alias("_session"), month_start(time).alias("_month")).agg(
        F.count(F.lit(1)).alias("_events"), F.min(F.col(time)).alias("_first"), F.max(F.col(time)).alias("_last")
    )
    return base.agg(
        F.coalesce(F.sum("_events"), F.lit(0).cast("bigint")).alias("total_events"),
        distinct_count("_user", approx_rsd).alias("unique_users"),
        distinct_count("_session", approx_rsd).alias("unique_sessions"),
        F.to_date(F.min("_first")).alias("first_day"),
        F.to_date(F.max("_last")).alias("last_day"),
        F.countDistinct("_month").alias("months_covered"),
    )


def profile_event_share(events: DataFrame, *, event_type: str = "event_type") -> DataFrame:
    """``event_type, events_count, share_pct`` by count descending.

    The share window runs over the grouped rows (one per event type) only.
    """
    grouped = events.groupBy(F.col(event_type).alias("event_type")).agg(F.count(F.lit(1)).alias("events_count"))
    total = F.sum("events_count").over(Window.partitionBy())
    return grouped.select("event_type", "events_count", pct(F.col("events_count"), total).alias("share_pct")).orderBy(
        F.desc("events_count"), "event_type"
    )


def profile_nulls(events: DataFrame, columns: Sequence[str] = DEFAULT_NULL_COLUMNS) -> DataFrame:
    """One row with ``null_<column>`` = number of events where the column is NULL."""
    return events.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])
