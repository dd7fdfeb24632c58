"""Event tables that are replaced at once, and loads that may be repeated.

A table folder holds version folders ``v-<id>`` and a file ``_current`` that names the one
in force. A write goes to a version of its own and is checked; only then the pointer is
renamed into place. Readers that have begun keep the old files; a write that
fails leaves the table as it was. ``vacuum`` deletes versions out of force.

``load_batch`` keeps each load in a partition of its own, ``load_id``: loading the same
file again replaces its rows and no others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the version in force, or None."""
    fs, place = _fs(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return f"{path.rstrip('/')}/{name}"


def _point(spark: SparkSession, path: str, name: str) -> None:
    """Name the version in force: a new file takes the old one's place by one rename."""
    fs, temporary = _fs(spark, f"{path.rstrip('/')}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(name.encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files.rename(temporary, spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}"), options)


def replace_events(events: DataFrame, path: str, *, check=None, **options) -> str:
    """Write ``events`` as the table's new version (options as for ``write_events``); the version's folder.

    ``check(table)`` may raise, with the new version as read back; the old one then stays in force.
    """
    from .events import write_events

    spark = events.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{name}"
    try:
        write_events(events, folder, mode="errorifexists", **options)
        if check is not None:
            check(spark.read.parquet(folder))
    except BaseException:
        fs, place = _fs(spark, folder)
        fs.delete(place, True)
        raise
    _point(spark, path, name)
    return folder


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The version in force; a reader keeps it however the table is replaced meanwhile (until ``vacuum``)."""
    folder = current_version(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no version of {path} is in force")
    return spark.read.parquet(folder)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete all versions but the one in force (run it when no reader of an old one is left); their names."""
    fs, place = _fs(spark, path)
    now = (current_version(spark, path) or "").rsplit("/", 1)[-1]
    gone = [s.getPath() for s in fs.listStatus(place) if s.isDirectory() and s.getPath().getName().startswith("v-") and s.getPath().getName() != now]
    for old in gone:
        fs.delete(old, True)
    return sorted(p.getName() for p in gone)


def load_batch(events: DataFrame, path: str, load_id: str) -> None:
    """Write ``events`` as the load ``load_id`` (a file's name, say): its rows replace those of an earlier load of that id.

    Partitions are ``load_id``, then ``event_date``. Only the partition of this load is overwritten, even
    the dates that the new rows no longer have.
    """
    if not load_id or "/" in load_id or "=" in load_id or load_id.startswith((".", "_")):
        raise ValueError("a load id is a plain name")
    dated = events.withColumn("event_date", F.to_date("event_time")).hint("rebalance", "event_date")
    ordered = dated.sortWithinPartitions("event_date", "event_type", "event_time")
    ordered.write.mode("overwrite").partitionBy("event_date").parquet(f"{path.rstrip('/')}/load_id={load_id}")
