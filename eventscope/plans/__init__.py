"""Session settings and multi-report plans."""

from .reports import FunnelReports, RetentionReports, Shared, cart_report, write_reports
from .session import SCALE_CONF, build_session, configure, cost_based, work_folder
from .suite import report_builders, run_suite

__all__ = [
    "SCALE_CONF",
    "FunnelReports",
    "RetentionReports",
    "Shared",
    "build_session",
    "cart_report",
    "configure",
    "cost_based",
    "report_builders",
    "run_suite",
    "work_folder",
    "write_reports",
]
