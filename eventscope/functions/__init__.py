"""Column expressions and distributed aggregates shared by the operators."""

from .exprs import (
    distinct_count,
    iso_day_of_week,
    iso_week,
    iso_year,
    month_index,
    month_label,
    month_start,
    pct,
    ratio,
    safe_den,
    seconds_between,
    week_start,
)
from .quantiles import exact_percentiles

__all__ = [
    "distinct_count",
    "exact_percentiles",
    "iso_day_of_week",
    "iso_week",
    "iso_year",
    "month_index",
    "month_label",
    "month_start",
    "pct",
    "ratio",
    "safe_den",
    "seconds_between",
    "week_start",
]
