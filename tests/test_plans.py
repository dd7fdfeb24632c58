"""Report plans over materialised intermediates give the same answers."""

from __future__ import annotations

import threading

import pytest

from eventscope.operators import cohort_activity, funnel_sessions, funnel_steps, retention_long
from eventscope.plans import FunnelReports, RetentionReports, write_reports

from .conftest import as_dicts


def test_funnel_reports_match_single_plans(session_events):
    rep = FunnelReports(session_events)
    assert as_dicts(rep.steps()) == as_dicts(funnel_steps(funnel_sessions(session_events)))
    assert as_dicts(rep.durations())[0]["median_sec_total"] is not None


def test_retention_reports_and_write(cohort_events, tmp_path, spark):
    rep = RetentionReports(cohort_events)
    assert as_dicts(rep.long()) == as_dicts(retention_long(cohort_activity(cohort_events)))
    paths = write_reports({"curve": rep.curve, "matrix": lambda: rep.matrix(4)}, str(tmp_path / "out"))
    assert spark.read.parquet(paths[0]).count() == 4
    assert spark.read.parquet(paths[1]).count() == 4


def test_suite_writes_every_report(session_events, tmp_path, spark):
    from eventscope.plans import run_suite

    paths = run_suite(session_events, str(tmp_path / "suite"))
    names = [p.rsplit("/", 1)[1] for p in paths]
    assert len(names) == 15 and "funnel_steps" in names and "retention_curve" in names
    steps = spark.read.parquet(str(tmp_path / "suite" / "funnel_steps")).orderBy("step_no").collect()
    assert [r["sessions"] for r in steps] == [9, 6, 2]
    outcomes = {r["cart_outcome"]: r["sessions"] for r in spark.read.parquet(str(tmp_path / "suite" / "cart_outcomes")).collect()}
    assert sorted(outcomes.values()) == [2, 3, 6]


def test_parallel_suite_materialises_shared_tables_once(session_events, tmp_path, monkeypatch):
    import eventscope.plans.suite as suite_mod

    built = {"funnel": 0, "cohorts": 0}
    real_funnel, real_cohorts = suite_mod.FunnelReports, suite_mod.RetentionReports

    # each waits for the other: they are built at the same time, not one after the other
    both = threading.Barrier(2, timeout=60)

    def funnel(events, work_dir=None):
        built["funnel"] += 1
        both.wait()
        return real_funnel(events, work_dir=work_dir)

    def cohorts(events, work_dir=None):
        built["cohorts"] += 1
        both.wait()
        return real_cohorts(events, work_dir=work_dir)

    monkeypatch.setattr(suite_mod, "FunnelReports", funnel)
    monkeypatch.setattr(suite_mod, "RetentionReports", cohorts)
    work = tmp_path / "work"
    paths = suite_mod.run_suite(session_events, str(tmp_path / "par"), parallelism=15, work_dir=str(work))
    assert len(paths) == 15 and built == {"funnel": 1, "cohorts": 1}
    assert [p for p in work.iterdir() if not p.name.endswith(".crc")] == []  # the shared tables are gone


def test_shared_folder_is_never_invented(spark, monkeypatch):
    from eventscope.plans import session

    class Bare:
        class sparkContext:  # noqa: N801
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_folder(Bare)
    assert session.work_folder(Bare, "/shared/x/") == "/shared/x"
    assert session.work_folder(spark)
