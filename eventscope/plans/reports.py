"""Report plans: several reports over one shared intermediate table.

A single report is one Spark plan and needs nothing from here. When a run
produces several reports from the same per-session funnel table or the same
cohort activity table, that table is written once as Parquet to the shared
folder (``spark.checkpoint.dir`` or ``work_dir``) so that

* the event scan and the session/user shuffles run once, not once per report;
* the lineage is cut: a lost executor costs a re-read of the files, not a
  recomputation from raw events;
* a report reads only its columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from ..operators.carts import cart_outcomes, cart_sessions
from ..operators.funnel import DEFAULT_STEPS, StepNames, funnel_by_period, funnel_durations, funnel_sessions, funnel_steps
from ..operators.retention import cohort_activity, retention_curve, retention_long, retention_matrix
from .session import work_folder


class Shared:
    """An intermediate table written once as Parquet to the shared folder; reports read only the columns they need."""

    def __init__(self, df: DataFrame, work_dir: str | None = None) -> None:
        self._spark = df.sparkSession
        self._path = f"{work_folder(self._spark, work_dir)}/eventscope-{uuid.uuid4().hex}"
        df.write.parquet(self._path)
        self.table = self._spark.read.schema(df.schema).parquet(self._path)

    def clean(self) -> None:
        """Delete the files; reports built on the table can no longer run."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


class FunnelReports:
    """Funnel reports 2.1-2.3 over one materialised per-session funnel table."""

    def __init__(
        self, events: DataFrame, steps: Sequence[str] = DEFAULT_STEPS, *, names: StepNames | None = None, work_dir: str | None = None, **columns: str
    ) -> None:
        self.names = names or StepNames.of(steps)
        self.shared = Shared(funnel_sessions(events, steps, names=self.names, **columns), work_dir)
        self.sessions = self.shared.table

    def steps(self, labels: Sequence[str] | None = None) -> DataFrame:
        return funnel_steps(self.sessions, labels, names=self.names)

    def monthly(self) -> DataFrame:
        return funnel_by_period(self.sessions, names=self.names)

    def durations(self) -> DataFrame:
        return funnel_durations(self.sessions, names=self.names)


class RetentionReports:
    """Cohort reports 3.1-3.4 over one materialised cohort activity table."""

    def __init__(self, events: DataFrame, *, work_dir: str | None = None, **columns: str) -> None:
        self.shared = Shared(cohort_activity(events, **columns), work_dir)
        self.activity = self.shared.table

    def matrix(self, months: int = 7, *, as_pct: bool = True, mask_unobserved: bool = False) -> DataFrame:
        return retention_matrix(self.activity, months, as_pct=as_pct, mask_unobserved=mask_unobserved)

    def long(self) -> DataFrame:
        return retention_long(self.activity)

    def curve(self, weighting: str = "cohort_size") -> DataFrame:
        return retention_curve(self.activity, weighting)


def write_reports(
    reports: dict[str, Callable[[], DataFrame]],
    out_dir: str,
    mode: str = "overwrite",
    parallelism: int = 1,
) -> list[str]:
    """Write each report as Parquet under ``out_dir/<name>``; returns the paths.

    Writes go through Spark's commit protocol, so a retried task or stage never
    leaves partial output behind. ``parallelism > 1`` submits that many report
    jobs at once from driver threads, so small reports do not leave executors
    idle while they run one after another.
    """
    def write(item: tuple[str, Callable[[], DataFrame]]) -> str:
        name, build = item
        path = f"{out_dir.rstrip('/')}/{name}"
        build().write.mode(mode).parquet(path)
        return path

    if parallelism <= 1:
        return [write(item) for item in reports.items()]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(write, reports.items()))


def cart_report(events: DataFrame, **kwargs) -> DataFrame:
    """Cart outcome report 2.4 (a single plan; nothing to share)."""
    return cart_outcomes(cart_sessions(events, **kwargs))
