"""Incremental loading of event files with Structured Streaming."""

from .load import read_event_files, start_event_load

__all__ = ["read_event_files", "start_event_load"]
