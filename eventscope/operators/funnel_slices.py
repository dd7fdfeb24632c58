"""One-scan funnel from session summaries that compose in time order.

A session's events are cut into slices of time (an hour by default). A slice is
summed up by what it does to a session that enters it with ``j`` steps done: the
times at which steps ``j + 1, j + 2, ...`` are completed inside the slice, for every ``j``.
Events of later slices are strictly later, so a session's funnel is the summaries
applied one after another, from no step done.

* Events are read once, whatever the number of steps.
* A slice of a session is the unit of the shuffle, so a session with a third of all
  rows is spread over as many groups as it has slices. Of a slice's first-step events
  only the earliest leaves a map task; of other steps the distinct times do.
* The second shuffle moves one small row per session and slice, and a session's
  fold is as long as the slices in which it has events.
* Summaries can be kept: a table of slices, with later slices appended, gives the
  funnel without reading the old events again. Events of one slice of a session must
  be summed up together, so append whole slices.

Same results as :func:`eventscope.operators.funnel.funnel_sessions`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .funnel import DEFAULT_STEPS, StepNames

HOUR = 3600


def _bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _completed(first: Column, later: list[Column]) -> Column:
    """Times of a step done at ``first`` and of those after it, each the earliest one strictly later; NULL when not reached."""
    if not later:
        return F.array(first)

    def follow(at: Column) -> Column:
        return F.concat(F.array(at), _completed(F.array_min(F.filter(later[0], lambda t: t > at)), later[1:]))

    return _bound(first, follow)


def funnel_slices(
    events: DataFrame,
    steps: Sequence[str] = DEFAULT_STEPS,
    *,
    session: str = "user_session",
    time: str = "event_time",
    event_type: str = "event_type",
    slice_seconds: int = HOUR,
) -> DataFrame:
    """``session, slice, runs``: one row per session and slice with events of the funnel.

    ``runs[j]`` holds the times at which the slice completes steps ``j + 1, j + 2, ...`` of a
    session that enters it with ``j`` steps done (NULL: not inside this slice).
    """
    steps = list(steps)
    if len(steps) < 2:
        raise ValueError("a funnel needs at least two steps")
    if slice_seconds < 1:
        raise ValueError("a slice has a second or more")
    at = F.col("_ts")
    kept = events.where(F.col(event_type).isin(*set(steps)) & F.col(time).isNotNull() & F.col(session).isNotNull()).select(
        F.col(session), F.col(event_type).alias("_kind"), F.col(time).alias("_ts"),
        F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / slice_seconds).cast("long").alias("slice"),
    )
    grouped = kept.groupBy(session, "slice").agg(
        F.min(F.when(F.col("_kind") == steps[0], at)).alias("_s0"),
        *[F.collect_set(F.when(F.col("_kind") == s, at)).alias(f"_s{k}") for k, s in enumerate(steps) if k],
    )
    lists = [F.col(f"_s{k}") for k in range(1, len(steps))]
    runs = [_completed(F.col("_s0"), lists)] + [_completed(F.array_min(lists[j]), lists[j + 1 :]) for j in range(len(lists))]
    return grouped.select(session, "slice", F.array(*runs).alias("runs"))


def funnel_from_slices(
    slices: DataFrame, steps: Sequence[str] = DEFAULT_STEPS, *, session: str = "user_session", names: StepNames | None = None
) -> DataFrame:
    """One row per session that reached step 1: ``session, t_1, ..., t_n`` as :func:`funnel_sessions` has them."""
    steps = list(steps)
    times = list((names or StepNames.of(steps)).times)
    if len(times) != len(steps) or len(set(times)) != len(times):
        raise ValueError("one time column name per step is required")
    kind = slices.schema["runs"].dataType.elementType
    in_order = slices.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("slice", "runs"))).alias("_slices"))

    def enter(done: Column, part: Column) -> Column:
        run = F.coalesce(F.get(part["runs"], F.size(done)), F.array().cast(kind))
        return F.concat(done, F.array_compact(run))

    folded = in_order.select(session, F.aggregate("_slices", F.array().cast(kind), enter).alias("_done"))
    return folded.where(F.size("_done") > 0).select(session, *[F.get("_done", F.lit(k)).alias(t) for k, t in enumerate(times)])
