"""Incremental version of the load step: new CSV files -> cleaned, partitioned Parquet.

This is the same staging read and :func:`~eventscope.sources.events.clean_events`
projection as the batch load, run as a Structured Streaming query so that files
dropped into a landing folder are appended to the event table as they arrive.
The Parquet file sink is exactly-once: its metadata log and the query's
checkpoint (offsets of processed files) survive driver and executor loss, and a
restarted query resumes where it stopped.

No analytical operator is streamed: every report reads the resulting table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.events import LOAD_SCHEMA, clean_events, csv_options


def read_event_files(spark: SparkSession, landing_dir: str, *, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of headered event CSV files as all-text columns."""
    reader = spark.readStream.schema(LOAD_SCHEMA).options(**csv_options())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(landing_dir)


def start_event_load(
    spark: SparkSession,
    landing_dir: str,
    table_dir: str,
    checkpoint_dir: str,
    *,
    on_error: str = "fail",
    available_now: bool = False,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start appending cleaned events, partitioned by ``event_date``, to ``table_dir``.

    ``available_now=True`` processes every file present and stops (a batch-style
    incremental run); otherwise the query keeps running on ``processing_time``.
    ``max_files_per_trigger`` bounds a batch, so that a first run does not take the
    whole backlog at once. ``checkpoint_dir`` must be on shared storage.
    """
    raw = read_event_files(spark, landing_dir, max_files_per_trigger=max_files_per_trigger)
    events = clean_events(raw, on_error=on_error)
    out = events.withColumn("event_date", F.to_date("event_time"))
    writer = (
        out.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint_dir)
        .partitionBy("event_date")
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start(table_dir)
