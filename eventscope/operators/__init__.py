"""DataFrame -> DataFrame analytics operators."""

from .activity import active_users, daily_report, growth, monthly_report, weekly_report
from .carts import cart_outcomes, cart_sessions
from .funnel import StepNames, funnel_by_period, funnel_durations, funnel_sessions, funnel_steps, step_durations
from .funnel_slices import funnel_from_slices, funnel_slices
from .lifetimes import cells_from_months, lifetimes, merge_months, user_months
from .quality import profile_event_share, profile_nulls, profile_volume
from .retention import (
    cohort_activity,
    cohort_activity_observed,
    cohort_cells,
    cohort_sizes,
    retention_curve,
    retention_long,
    retention_matrix,
)
from .rollups import active_from_days, add_users, day_bitmaps, day_sketches, estimated_from_days, merge_days, monthly_growth, number_users

__all__ = [
    "StepNames",
    "active_from_days",
    "active_users",
    "add_users",
    "cart_outcomes",
    "cart_sessions",
    "cells_from_months",
    "cohort_activity",
    "cohort_activity_observed",
    "cohort_cells",
    "cohort_sizes",
    "daily_report",
    "day_bitmaps",
    "day_sketches",
    "estimated_from_days",
    "funnel_by_period",
    "funnel_durations",
    "funnel_from_slices",
    "funnel_sessions",
    "funnel_slices",
    "funnel_steps",
    "growth",
    "lifetimes",
    "merge_days",
    "merge_months",
    "monthly_growth",
    "monthly_report",
    "number_users",
    "profile_event_share",
    "profile_nulls",
    "profile_volume",
    "retention_curve",
    "retention_long",
    "retention_matrix",
    "step_durations",
    "user_months",
    "weekly_report",
]
