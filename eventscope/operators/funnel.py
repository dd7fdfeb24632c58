"""Strictly ordered session funnel (view -> cart -> purchase, or any n steps).

Semantics
---------
* The unit is the session; events with a NULL session or an unknown time are
  ignored (a time is never unknown after a strict load, see ``clean_events``).
* Step 1 time is the session's earliest step-1 event.
* Step k (k > 1) time is the earliest step-k event *strictly later* than the
  step k-1 time; an event at the same instant does not advance the funnel, and a
  step-k event before step k-1 is skipped while a later one still counts.
* Each step is searched after the previous *step*, so every step's sessions are
  a subset of the previous step's.

Plan shape (why not one window per session)
-------------------------------------------
A window partitioned by session puts every event of a session in one task, so a
single bot session holding a third of the table would run on one core. Instead
each step is a per-session aggregate:

* step 1 is ``min(time)`` grouped by session -- partial aggregation collapses a
  hot session to one row per map task before the shuffle, and step-1 events
  (usually the largest class) are never shuffled raw;
* step k joins the step-k events to the (one row per session) step k-1 table on
  ``(session, xxhash64(session))`` and takes ``min(time)`` of the later events.
  The extra key makes both join inputs arrive through fresh shuffles, the shape
  AQE's skew-join rule (see :mod:`eventscope.plans.session`) splits, so a hot
  session's partition is spread over several tasks; the following aggregate is
  partial again.

The per-session step tables are all hash-partitioned on the session; their
union keeps that partitioning, so one in-place aggregate assembles the output
row per session (no join, no sort, no extra exchange). Each step table reaches
both the next join and the assembly through the same exchange, which AQE
reuses: every sort-merge join runs once.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import month_label, month_start, pct, seconds_between, week_start
from ..functions.quantiles import exact_percentiles

DEFAULT_STEPS = ("view", "cart", "purchase")


class StepNames(NamedTuple):
    """Names of a funnel's steps in the reports: role (column suffix), time column, label."""

    roles: tuple[str, ...]
    times: tuple[str, ...]
    labels: tuple[str, ...]

    @classmethod
    def of(cls, steps: Sequence[str]) -> StepNames:
        """The published names for the published steps, else names made from the event types."""
        if tuple(steps) == DEFAULT_STEPS:
            return PUBLISHED
        return cls(tuple(steps), tuple(f"{s}_at" for s in steps), tuple(steps))


# Output names of the published report (fixed values), for its own steps only.
PUBLISHED = StepNames(
    roles=("view", "cart", "purchase"), times=("viewed_at", "carted_at", "purchased_at"), labels=("View", "Cart", "Purchase")
)


def funnel_sessions(
    events: DataFrame,
    steps: Sequence[str] = DEFAULT_STEPS,
    *,
    session: str = "user_session",
    time: str = "event_time",
    event_type: str = "event_type",
    names: StepNames | None = None,
    skew_split: bool = True,
) -> DataFrame:
    """One row per session that reached step 1: ``session, t_1, ..., t_n``.

    ``t_k`` is NULL when the session stopped before step k. The time columns are
    ``names.times``: ``viewed_at, carted_at, purchased_at`` for the published steps,
    ``<event type>_at`` for others unless ``names`` says otherwise. Pass the same
    ``names`` to the reports below.

    ``skew_split=False`` joins on the session alone: use it on input already
    bucketed by session (no session dominating), where events are then never
    shuffled -- the joins read co-located buckets, and only the per-session
    rows may move for the final assembly. Without a shared exchange the
    intermediate step joins are evaluated once per consumer (CPU only).
    """
    steps = list(steps)
    if len(steps) < 2:
        raise ValueError("a funnel needs at least two steps")
    names = list((names or StepNames.of(steps)).times)
    if len(names) != len(steps) or len(set(names)) != len(names):
        raise ValueError("one time column name per step is required")

    def step_events(k: int) -> DataFrame:
        # Only this step's events with a session and a time leave the scan. The
        # type test comes first: it is pushed into the Parquet reader and is
        # the cheap, selective one, so a derived session key is only computed
        # for matching rows.
        return (
            events.where(F.col(event_type) == F.lit(steps[k]))
            .where(F.col(time).isNotNull() & F.col(session).isNotNull())
            .select(F.col(session), F.col(time).alias("_ts"))
        )

    first = step_events(0).groupBy(session).agg(F.min("_ts").alias(names[0]))
    tables = [first]
    previous, prev_name = first, names[0]
    for k in range(1, len(steps)):
        # Joining on (session, hash(session)) rather than on the session alone
        # makes Spark shuffle *both* inputs for this join (co-partitioning needs
        # every join key), which is the shape AQE's skew-join rule can split.
        left, right, keys = step_events(k), previous.select(session, prev_name), [session]
        if skew_split:
            left, right = left.withColumn("_h", F.xxhash64(session)), right.withColumn("_h", F.xxhash64(session))
            keys = [session, "_h"]
        reached = (
            left.join(right, on=keys)
            .where(F.col("_ts") > F.col(prev_name))
            .groupBy(session)
            .agg(F.min("_ts").alias(names[k]))
        )
        tables.append(reached)
        previous, prev_name = reached, names[k]

    # Assemble one row per session without joins: every step table is already
    # hash-partitioned on the session, the union keeps that partitioning, and
    # the final aggregate runs in place (no exchange, no sort).
    ts_type = events.schema[time].dataType.simpleString()
    parts = [
        t.selectExpr(f"`{session}`", *[f"`{n}`" if j == i else f"CAST(NULL AS {ts_type}) AS `{n}`" for j, n in enumerate(names)])
        for i, t in enumerate(tables)
    ]
    assembled = parts[0]
    for p in parts[1:]:
        assembled = assembled.unionByName(p)
    return assembled.groupBy(session).agg(*[F.max(n).alias(n) for n in names])


def funnel_steps(
    sessions: DataFrame,
    labels: Sequence[str] | None = None,
    *,
    names: StepNames = PUBLISHED,
) -> DataFrame:
    """Funnel in long form with conversion and losses (one row per step).

    Columns: ``step_no, step_name, sessions, micro_cr_pct, macro_cr_pct,
    sessions_lost, drop_off_pct``. Micro is against the previous step, macro
    against step 1; the first step has NULL micro, loss and drop-off.

    The per-step counts are one global aggregate (partial counts per task, one
    row after the merge); conversions are computed on that single row and then
    unpivoted, so no window or sort runs over data.
    """
    n = len(names.times)
    labels = list(labels or names.labels)
    totals = sessions.agg(*[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(names.times)])

    def hundred_times(num: str, den: str) -> str:
        return f"round(100.0 * ({num}) / nullif({den}, 0), 2)"

    rows = []
    for i in range(n):
        cur, prev = f"_n{i}", (f"_n{i - 1}" if i else "CAST(NULL AS BIGINT)")
        label = labels[i].replace("'", "''")
        rows.append(
            f"named_struct('step_no', {i + 1}, 'step_name', '{label}', 'sessions', {cur}, "
            f"'micro_cr_pct', {hundred_times(cur, prev)}, 'macro_cr_pct', {hundred_times(cur, '_n0')}, "
            f"'sessions_lost', {prev} - {cur}, 'drop_off_pct', {hundred_times(f'{prev} - {cur}', prev)})"
        )
    return totals.selectExpr(f"inline(array({', '.join(rows)}))")


def funnel_by_period(
    sessions: DataFrame,
    grain: str = "month",
    *,
    names: StepNames = PUBLISHED,
) -> DataFrame:
    """Funnel per period of the step-1 event (entry period): month, ISO week or day.

    A session that crosses a period end belongs to the period it entered.
    Columns for three steps by month: ``month, month_label, sessions_view,
    sessions_cart, sessions_purchase, cr_view_to_cart_pct,
    cr_cart_to_purchase_pct, cr_macro_pct`` (``week``/``day`` grains name the
    first two columns ``week, week_label`` / ``day, day_label``).
    """
    roles, times = names.roles, names.times
    entered = F.col(times[0])
    period, label = {
        "month": (month_start(entered), month_label(entered)),
        "week": (week_start(entered), F.date_format(week_start(entered), "yyyy-MM-dd")),
        "day": (F.to_date(entered), F.date_format(entered, "yyyy-MM-dd")),
    }[grain]
    counts = [F.count(F.col(c)).alias(f"sessions_{r}") for c, r in zip(times, roles)]
    grouped = sessions.groupBy(period.alias(grain), label.alias(f"{grain}_label")).agg(*counts)
    ratios: list[Column] = [
        pct(f"sessions_{roles[i + 1]}", f"sessions_{roles[i]}").alias(f"cr_{roles[i]}_to_{roles[i + 1]}_pct")
        for i in range(len(roles) - 1)
    ]
    ratios.append(pct(f"sessions_{roles[-1]}", f"sessions_{roles[0]}").alias("cr_macro_pct"))
    return grouped.select(grain, f"{grain}_label", *[f"sessions_{r}" for r in roles], *ratios).orderBy(grain)


def step_durations(
    sessions: DataFrame,
    *,
    session: str = "user_session",
    names: StepNames = PUBLISHED,
) -> DataFrame:
    """Seconds between consecutive steps and in total, per session that reached step 2.

    Three-step columns: ``sec_view_to_cart, sec_cart_to_purchase, sec_total``
    (decimal seconds with microsecond precision; NULL when the step was not reached).
    """
    roles, times = names.roles, names.times
    cols = [
        seconds_between(times[i], times[i + 1]).alias(f"sec_{roles[i]}_to_{roles[i + 1]}")
        for i in range(len(times) - 1)
    ]
    cols.append(seconds_between(times[0], times[-1]).alias("sec_total"))
    return sessions.where(F.col(times[1]).isNotNull()).select(session, *cols)


def funnel_durations(
    sessions: DataFrame,
    probs: Sequence[float] = (0.5, 0.9),
    *,
    session: str = "user_session",
    names: StepNames = PUBLISHED,
) -> DataFrame:
    """One-row summary of step durations with exact interpolated percentiles.

    Columns (three steps, default ``probs``): ``sessions_with_cart,
    sessions_with_purchase, median_sec_view_to_cart, p90_sec_view_to_cart,
    median_sec_cart_to_purchase, p90_sec_cart_to_purchase, median_sec_total``
    (percentiles rounded to 1 digit). ``probs`` are the levels reported for each
    step-to-step gap (0.5 is named ``median``, others ``p<percent>``); the total
    duration is reported as its median.
    """
    roles = names.roles
    durations = step_durations(sessions, session=session, names=names)
    gaps = [f"sec_{roles[i]}_to_{roles[i + 1]}" for i in range(len(roles) - 1)]

    def level(p: float) -> str:
        return "median" if p == 0.5 else f"p{100 * p:g}".replace(".", "_")

    targets = [(f"{level(p)}_{g}", g, p) for g in gaps for p in probs]
    targets.append(("median_sec_total", "sec_total", 0.5))

    # Every step-2 session has a step-1 -> step-2 gap, so its count is the
    # number of sessions with a cart; the last gap counts completed sessions.
    quantiles = exact_percentiles(durations, targets)
    counts = [F.col(f"n_{gaps[0]}").alias(f"sessions_with_{roles[1]}")]
    if len(gaps) > 1:
        counts.append(F.col(f"n_{gaps[-1]}").alias(f"sessions_with_{roles[-1]}"))
    return quantiles.select(*counts, *[F.round(F.col(a).cast("decimal(38,6)"), 1).alias(a) for a, _, _ in targets])
