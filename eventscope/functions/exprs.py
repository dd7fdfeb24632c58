"""Column expressions shared by the operators.

Everything here returns a ``Column`` built from built-in Spark functions, so it
stays inside whole-stage codegen. Ratios are computed in decimal arithmetic and
rounded half away from zero, like SQL ``NUMERIC``; a zero denominator gives NULL
instead of an ANSI division error.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

_HUNDRED = Decimal("100.0")
_ONE = Decimal("1.0")


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_den(den: ColumnOrName) -> Column:
    """``NULLIF(den, 0)``: a zero denominator yields NULL, not an error."""
    return F.nullif(col(den), F.lit(0))


def ratio(num: ColumnOrName, den: ColumnOrName, digits: int = 2,
          scale: Decimal = _ONE) -> Column:
    """``ROUND(scale * num / NULLIF(den, 0), digits)`` in exact decimal arithmetic.

    ``num`` and ``den`` are Columns or SQL expression strings (e.g. a column
    name); with two strings the whole expression is one SQL expression.
    """
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(f"round({scale} * ({num}) / nullif(({den}), 0), {digits})")
    return F.round(F.lit(scale) * _expr(num) / safe_den(_expr(den)), digits)


def pct(num: ColumnOrName, den: ColumnOrName, digits: int = 2) -> Column:
    """Percentage ``ROUND(100.0 * num / NULLIF(den, 0), digits)``."""
    return ratio(num, den, digits, _HUNDRED)


def _expr(c: ColumnOrName) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def month_start(ts: ColumnOrName) -> Column:
    """First day of the month of a timestamp or date, as a DATE."""
    return F.trunc(F.to_date(col(ts)), "month")


def week_start(ts: ColumnOrName) -> Column:
    """Monday of the ISO week of a timestamp or date, as a DATE."""
    return F.to_date(F.date_trunc("week", F.to_date(col(ts))))


def month_index(ts: ColumnOrName) -> Column:
    """Months since year 0: ``year * 12 + month - 1``.

    The difference of two indexes is the calendar month difference
    ``(Y2 - Y1) * 12 + (M2 - M1)``, independent of the day of the month.
    """
    c = col(ts)
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def month_from_index(idx: ColumnOrName) -> Column:
    """Inverse of :func:`month_index`: the first day of that month."""
    i = col(idx)
    return F.make_date(F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"), F.lit(1))


def iso_day_of_week(d: ColumnOrName) -> Column:
    """ISO day of week, Monday = 1 .. Sunday = 7."""
    return (F.weekday(col(d)) + 1).cast("int")


def iso_year(d: ColumnOrName) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(d)).cast("int")


def iso_week(d: ColumnOrName) -> Column:
    return F.weekofyear(col(d)).cast("int")


def seconds_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``EXTRACT(EPOCH FROM end - start)`` with microsecond precision, as decimal.

    ``unix_timestamp`` would truncate to whole seconds; the microsecond
    difference keeps sub-second steps exact.
    """
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return micros.cast("decimal(20,0)") / F.lit(Decimal("1000000"))


def month_label(d: ColumnOrName) -> Column:
    """``TO_CHAR(d, 'YYYY-MM')``."""
    return F.date_format(col(d), "yyyy-MM")


def distinct_count(c: str, approx_rsd: float | None = None) -> Column:
    """Exact ``COUNT(DISTINCT c)``, or a HyperLogLog++ estimate with relative
    standard deviation ``approx_rsd``: fixed-size sketches merged map-side, so
    no distinct key is shuffled (opt-in for very large user sets)."""
    if approx_rsd is None:
        return F.countDistinct(F.col(c))
    return F.approx_count_distinct(F.col(c), approx_rsd)
