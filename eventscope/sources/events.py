"""Load raw event CSV, clean and type it, write it in a query-friendly layout.

The raw file is read with every column as text so that empty or malformed
fields never fail the scan; :func:`clean_events` then turns empty strings into
NULL and casts to the typed schema in one narrow projection (no shuffle). Rows
with too few or too many fields, malformed values and over-long texts fail the
load, or become counted NULLs on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The event-log columns, in file order.
EVENT_COLUMNS = (
    "event_time",
    "event_type",
    "product_id",
    "category_id",
    "category_code",
    "brand",
    "price",
    "user_id",
    "user_session",
)

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in EVENT_COLUMNS])

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.TimestampType(), True),
        T.StructField("event_type", T.StringType(), True),
        T.StructField("product_id", T.LongType(), True),
        T.StructField("category_id", T.LongType(), True),
        T.StructField("category_code", T.StringType(), True),
        T.StructField("brand", T.StringType(), True),
        T.StructField("price", T.DecimalType(10, 2), True),
        T.StructField("user_id", T.LongType(), True),
        T.StructField("user_session", T.StringType(), True),
    ]
)

# Columns whose empty string means "missing"; event_time and event_type are kept as given.
_NULLABLE_TEXT = ("product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session")

# The longest text the event table takes in these columns.
TEXT_LIMITS = {"event_type": 20, "category_code": 200, "brand": 100, "user_session": 36}

# A timestamp needs a date; the time of day and the zone may be missing.
TIMESTAMP_PATTERN = (
    r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?\s*([Zz]|[A-Z]{3,4}|[A-Za-z]+/[A-Za-z_]+|[+-]\d{1,2}(:?\d{2})?)?\s*$"
)

# Holds the line of a row whose number of fields is not that of the file.
CORRUPT_COLUMN = "_corrupt_record"
LOAD_SCHEMA = T.StructType([*RAW_SCHEMA.fields, T.StructField(CORRUPT_COLUMN, T.StringType(), True)])

ON_ERROR = ("fail", "null")


def csv_options(*, header: bool = True) -> dict[str, str]:
    """Reader options of the staging files, shared by the batch, streaming and line-by-line readers."""
    return {
        "header": str(header).lower(), "quote": '"', "escape": '"', "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT_COLUMN,
        # the width of a row is only seen if all its fields are parsed
        "columnPruning": "false",
    }


def load_events(spark: SparkSession, path: str | list[str], *, header: bool = True, multi_line: bool = False) -> DataFrame:
    """Scan headered event CSV file(s) as all-text columns (lazy, split across tasks).

    Doubled quotes inside quoted fields are unescaped (``escape='"'``); both
    ``,,`` and ``,"",`` read as NULL. A row with too few or too many fields keeps its
    line in ``_corrupt_record``. ``multi_line=True`` reads quoted fields that hold line
    breaks; such files are split too (:mod:`eventscope.sources.records`), after a first
    pass that runs at the call and keeps the lines in ``spark.checkpoint.dir``.
    """
    if multi_line:
        from .records import load_records

        return load_records(spark, path, header=header)
    return spark.read.schema(LOAD_SCHEMA).options(**csv_options(header=header)).csv(path)


def parsed_line(column: str) -> Column:
    """The struct of :data:`LOAD_SCHEMA` in a CSV line or record (without a header)."""
    options = {k: v for k, v in csv_options().items() if k != "header"}
    return F.from_csv(F.col(column), LOAD_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " "), options)


def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The columns of :func:`load_events` from a text column of CSV lines (without a header)."""
    return lines.select(parsed_line(column).alias("_e")).select("_e.*")


def _typed(raw: DataFrame) -> dict[str, tuple[Column, Column, Column]]:
    """Per column: its text (``''`` as NULL), the typed value or NULL, and whether the text is malformed."""
    fields = {f.name: f.dataType for f in EVENT_SCHEMA.fields}
    out = {}
    for c in EVENT_COLUMNS:
        value = F.nullif(F.col(c), F.lit("")) if c in _NULLABLE_TEXT else F.col(c)
        if isinstance(fields[c], T.StringType):
            typed = F.when(F.length(value) <= TEXT_LIMITS[c], value) if c in TEXT_LIMITS else value
        elif isinstance(fields[c], T.TimestampType):
            typed = F.when(value.rlike(TIMESTAMP_PATTERN), value).try_cast(fields[c])
        else:
            typed = value.try_cast(fields[c])
        out[c] = value, typed, value.isNotNull() & typed.isNull()
    return out


def _corrupt(raw: DataFrame) -> Column:
    return F.col(CORRUPT_COLUMN).isNotNull() if CORRUPT_COLUMN in raw.columns else F.lit(False)


def clean_events(raw: DataFrame, on_error: str = "fail") -> DataFrame:
    """Typed events from raw text columns.

    * ``''`` becomes NULL for every column but ``event_time`` and ``event_type``;
    * ``event_time`` accepts ``yyyy-MM-dd[ HH:mm[:ss[.ffffff]]][ zone]``; a date is required;
    * ``price`` is stored as ``decimal(10,2)``, rounded half away from zero;
    * texts may be as long as the table's columns (`TEXT_LIMITS`).

    ``on_error="fail"`` raises on a malformed, out-of-range or over-long value and
    on a row with too few or too many fields (whatever the session's ANSI
    setting). ``on_error="null"`` turns the value into NULL, and every column of
    such a row; :func:`load_errors` counts them.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    corrupt = _corrupt(raw)
    out = []
    for c, (value, typed, bad) in _typed(raw).items():
        if on_error == "null":
            out.append(F.when(~corrupt, typed).alias(c))
            continue
        # Explicit failure, independent of the session's ANSI setting.
        failure = F.raise_error(F.concat(F.lit(f"malformed {c}: '"), value, F.lit("'")))
        checked = F.when(bad, failure).otherwise(typed)
        if CORRUPT_COLUMN in raw.columns:
            width = F.raise_error(F.concat(F.lit("malformed row: '"), F.col(CORRUPT_COLUMN), F.lit("'")))
            checked = F.when(corrupt, width).otherwise(checked)
        out.append(checked.alias(c))
    return raw.select(*out)


def load_errors(raw: DataFrame) -> DataFrame:
    """One row: ``corrupt_rows`` and, per column, ``bad_<column>``: what ``on_error="null"`` turns into NULL."""
    corrupt = _corrupt(raw)
    return raw.agg(
        F.count_if(corrupt).alias("corrupt_rows"),
        *[F.count_if(~corrupt & bad).alias(f"bad_{c}") for c, (_, _, bad) in _typed(raw).items()],
    )


def write_events(
    events: DataFrame,
    path: str,
    *,
    mode: str = "overwrite",
    partition_by_date: bool = True,
    rebalance: bool = True,
    point_columns: tuple[str, ...] = ("user_id", "user_session"),
    values_per_row_group: int = 1_000_000,
) -> None:
    """Write typed events as Parquet partitioned by UTC ``event_date``.

    Date partitions let time-range queries prune whole directories; within a
    partition rows are sorted by event type and time so Parquet min/max
    statistics skip row groups for ``event_type`` filters.

    ``rebalance`` (default) first redistributes rows by date with Spark's
    ``REBALANCE`` hint: AQE splits a date holding a large share of the rows
    into advisory-size pieces and merges small ones, so each task writes about
    one well-sized file per date instead of one small file per date it happens
    to contain.

    ``point_columns`` get a Parquet bloom filter per row group, sized for
    ``values_per_row_group`` distinct values: rows are not in their order, so minimum and
    maximum skip nothing, but a filter on one user or session then reads only the
    row groups that hold it.
    """
    out = events
    writer_cols: list[str] = []
    if partition_by_date:
        out = out.withColumn("event_date", F.to_date("event_time"))
        writer_cols = ["event_date"]
        if rebalance:
            out = out.hint("rebalance", "event_date")
    out = out.sortWithinPartitions(*writer_cols, "event_type", "event_time")
    writer = out.write.mode(mode)
    for c in point_columns:
        if c in events.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(
                f"parquet.bloom.filter.expected.ndv#{c}", str(values_per_row_group)
            )
    if writer_cols:
        writer = writer.partitionBy(*writer_cols)
    writer.parquet(path)


def write_events_table(
    events: DataFrame,
    table: str,
    *,
    buckets: int,
    bucket_column: str = "user_session",
    mode: str = "overwrite",
    analyze: bool = True,
) -> None:
    """Save as a catalog table bucketed by session and sorted by time.

    Joins and aggregations keyed by session then read co-located buckets and
    skip the shuffle; ``ANALYZE`` records column statistics for the optimizer.
    Choose ``buckets`` so one bucket fits a task (e.g. table bytes / 256 MB).

    A bucket is read by one task, so this layout only pays when no single
    session holds a large share of the rows. With a dominant session keep the
    date-partitioned layout of :func:`write_events`: there the session
    aggregates pre-aggregate map-side and AQE splits the skewed partition.
    """
    (
        events.write.mode(mode)
        .bucketBy(buckets, bucket_column)
        .sortBy(bucket_column, "event_time")
        .saveAsTable(table)
    )
    if analyze:
        columns = ", ".join(dict.fromkeys(["event_time", "event_type", "user_id", bucket_column]))
        events.sparkSession.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {columns}")


def write_dated_table(events: DataFrame, table: str, *, mode: str = "overwrite", analyze: bool = True, histogram_bins: int = 64) -> None:
    """Save as a catalog table in the date-partitioned layout, with statistics and column histograms.

    ``ANALYZE`` counts rows and, for the columns that reports filter, group or join by, distinct
    values, NULLs, ranges and equi-height histograms. Under
    :func:`eventscope.plans.session.cost_based` Spark estimates the rows of filters and joins from them.
    """
    spark = events.sparkSession
    dated = events.withColumn("event_date", F.to_date("event_time")).hint("rebalance", "event_date")
    dated.sortWithinPartitions("event_date", "event_type", "event_time").write.mode(mode).partitionBy("event_date").saveAsTable(table)
    if not analyze:
        return
    settings = {"spark.sql.statistics.histogram.enabled": "true", "spark.sql.statistics.histogram.numBins": str(histogram_bins)}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS event_time, event_type, user_id, user_session")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Read events written by :func:`write_events`.

    The ``event_date`` partition column is kept: filter on it (next to any
    ``event_time`` range) to prune whole date directories.
    """
    return spark.read.parquet(path)
