"""Event-log sources and sinks."""

from .events import (
    EVENT_COLUMNS,
    EVENT_SCHEMA,
    RAW_SCHEMA,
    clean_events,
    load_errors,
    load_events,
    parse_event_lines,
    read_events,
    write_dated_table,
    write_events,
    write_events_table,
)
from .quarantine import load_with_quarantine, quarantined, read_clean, read_quarantine
from .records import csv_records, load_records
from .tables import clickstream_events, order_events, read_table
from .versions import current_version, load_batch, read_current, replace_events, vacuum

__all__ = [
    "EVENT_COLUMNS",
    "EVENT_SCHEMA",
    "RAW_SCHEMA",
    "clean_events",
    "clickstream_events",
    "csv_records",
    "current_version",
    "load_batch",
    "load_errors",
    "load_events",
    "load_records",
    "load_with_quarantine",
    "order_events",
    "parse_event_lines",
    "quarantined",
    "read_clean",
    "read_current",
    "read_events",
    "read_quarantine",
    "read_table",
    "replace_events",
    "vacuum",
    "write_dated_table",
    "write_events",
    "write_events_table",
]
