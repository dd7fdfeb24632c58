"""Command line: load raw event CSV into the event table, then compute every report.

    python -m eventscope load   <csv path or glob> <table dir> [--on-error null | --quarantine <dir>] [--versioned | --load-id <name>]
    python -m eventscope report <table dir> <reports dir> [--parallelism 4]

(or the same arguments through ``spark-submit``). On a cluster, set
``spark.checkpoint.dir`` to a shared folder; the reports checkpoint the shared
per-session and per-user tables there.
"""

from __future__ import annotations

import argparse

from .plans.session import build_session
from .plans.suite import run_suite
from .sources.events import clean_events, load_events, read_events, write_events
from .sources.quarantine import load_with_quarantine, read_clean
from .sources.versions import current_version, load_batch, read_current, replace_events


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="eventscope")
    sub = parser.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="CSV -> cleaned, date-partitioned Parquet table")
    load.add_argument("source")
    load.add_argument("table")
    load.add_argument("--on-error", choices=["fail", "null"], default="fail")
    load.add_argument("--quarantine", metavar="DIR", help="keep rejected rows there (with the clean ones) instead of failing")
    kind = load.add_mutually_exclusive_group()
    kind.add_argument("--versioned", action="store_true", help="replace the table at once; a failed load leaves the old one")
    kind.add_argument("--load-id", help="a name for this load: loading it again replaces its rows only")
    load.add_argument("--multi-line", action="store_true", help="quoted fields may hold line breaks")
    report = sub.add_parser("report", help="every report of the event table, one Parquet folder each")
    report.add_argument("table")
    report.add_argument("out")
    report.add_argument("--parallelism", type=int, default=4, help="report jobs submitted at once")
    report.add_argument("--work-dir", help="shared folder of intermediate tables (default: spark.checkpoint.dir)")
    args = parser.parse_args(argv)

    spark = build_session(app_name=f"eventscope-{args.command}")
    if args.command == "load":
        raw = load_events(spark, args.source, multi_line=args.multi_line)
        if args.quarantine:
            print(load_with_quarantine(raw, args.quarantine))
            events = read_clean(spark, args.quarantine)
        else:
            events = clean_events(raw, on_error=args.on_error)
        if args.versioned:
            replace_events(events, args.table)
        elif args.load_id:
            load_batch(events, args.table, args.load_id)
        else:
            write_events(events, args.table)
    else:
        events = read_current(spark, args.table) if current_version(spark, args.table) else read_events(spark, args.table)
        for path in run_suite(events, args.out, parallelism=args.parallelism, work_dir=args.work_dir):
            print(path)


if __name__ == "__main__":
    main()
