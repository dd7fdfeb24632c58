"""The full report suite: every report of the original four scripts in one run.

``run_suite`` takes typed events (see :mod:`eventscope.sources.events`) and
writes one Parquet folder per report:

* sanity checks after load: ``volume``, ``event_share``, ``nulls``;
* block 1 (activity): ``daily``, ``weekly``, ``monthly``;
* block 2 (funnel): ``funnel_steps``, ``funnel_monthly``, ``funnel_durations``, ``cart_outcomes``;
* block 3 (cohorts): ``retention_pct``, ``retention_users``, ``retention_long``, ``retention_curve``
  (plus ``retention_curve_row_fanout`` for parity with the published arithmetic).

The per-session funnel table and the cohort activity table are written once to
the shared folder and every report of their block reads them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.activity import daily_report, monthly_report, weekly_report
from ..operators.quality import DEFAULT_NULL_COLUMNS, profile_event_share, profile_nulls, profile_volume
from .reports import FunnelReports, RetentionReports, cart_report, write_reports


class _Once:
    """Values made on first use, each under its own lock, so that different ones are made at the same time."""

    def __init__(self, **makers: Callable[[], object]) -> None:
        self._makers = makers
        self._locks = {key: threading.Lock() for key in makers}
        self.made: dict[str, object] = {}

    def __call__(self, key: str) -> object:
        with self._locks[key]:
            if key not in self.made:
                self.made[key] = self._makers[key]()
            return self.made[key]


def report_builders(events: DataFrame, work_dir: str | None = None, shared: _Once | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Report builders by name; the two intermediate tables are written on first use,
    once each, also when reports are built from several threads."""
    shared = shared or shared_tables(events, work_dir)
    funnel, cohorts = lambda: shared("funnel"), lambda: shared("cohorts")
    return {
        "volume": lambda: profile_volume(events),
        "event_share": lambda: profile_event_share(events),
        "nulls": lambda: profile_nulls(events, [c for c in DEFAULT_NULL_COLUMNS if c in events.columns]),
        "daily": lambda: daily_report(events),
        "weekly": lambda: weekly_report(events),
        "monthly": lambda: monthly_report(events),
        "funnel_steps": lambda: funnel().steps(),
        "funnel_monthly": lambda: funnel().monthly(),
        "funnel_durations": lambda: funnel().durations(),
        "cart_outcomes": lambda: cart_report(events),
        "retention_pct": lambda: cohorts().matrix(),
        "retention_users": lambda: cohorts().matrix(as_pct=False),
        "retention_long": lambda: cohorts().long(),
        "retention_curve": lambda: cohorts().curve(),
        "retention_curve_row_fanout": lambda: cohorts().curve("row_fanout"),
    }


def shared_tables(events: DataFrame, work_dir: str | None = None) -> _Once:
    return _Once(
        funnel=lambda: FunnelReports(events, work_dir=work_dir), cohorts=lambda: RetentionReports(events, work_dir=work_dir)
    )


def run_suite(events: DataFrame, out_dir: str, mode: str = "overwrite", parallelism: int = 4, work_dir: str | None = None) -> list[str]:
    """Compute every report and write it under ``out_dir/<name>``; returns the paths.

    ``parallelism`` report jobs run at once (see :func:`write_reports`). The
    intermediate tables are deleted when all reports are written.
    """
    shared = shared_tables(events, work_dir)
    try:
        return write_reports(report_builders(events, work_dir, shared), out_dir, mode, parallelism)
    finally:
        for reports in shared.made.values():
            reports.shared.clean()
