"""eventscope: product analytics over raw event logs on Spark DataFrames.

Subpackages: ``sources`` (load, clean, layouts), ``operators`` (the reports),
``functions`` (shared expressions, exact percentiles), ``plans`` (session
settings, multi-report plans, the full suite) and ``streaming`` (incremental
load).
"""

from . import functions, operators, plans, sources, streaming
from .operators import (
    active_users,
    cart_outcomes,
    cart_sessions,
    cohort_activity,
    daily_report,
    funnel_by_period,
    funnel_durations,
    funnel_sessions,
    funnel_steps,
    growth,
    monthly_report,
    profile_event_share,
    profile_nulls,
    profile_volume,
    retention_curve,
    retention_long,
    retention_matrix,
    step_durations,
    weekly_report,
)
from .plans import build_session, configure, run_suite
from .sources import clean_events, load_events, read_events, write_events

__all__ = [
    "active_users",
    "build_session",
    "cart_outcomes",
    "cart_sessions",
    "clean_events",
    "cohort_activity",
    "configure",
    "daily_report",
    "functions",
    "funnel_by_period",
    "funnel_durations",
    "funnel_sessions",
    "funnel_steps",
    "growth",
    "load_events",
    "monthly_report",
    "operators",
    "plans",
    "profile_event_share",
    "profile_nulls",
    "profile_volume",
    "read_events",
    "retention_curve",
    "retention_long",
    "retention_matrix",
    "run_suite",
    "sources",
    "step_durations",
    "streaming",
    "weekly_report",
    "write_events",
]
