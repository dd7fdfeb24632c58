"""Views of other event-shaped tables in the event-log column names.

The operators default to the event-log columns (``event_time, event_type,
user_id, user_session, price``). These adapters are plain projections: Catalyst
prunes the unused ones and pushes filters through the aliases into the scan, so
they cost nothing at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Parquet scan of ``<directory>/<name>.parquet``; the files are listed anew by every call."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def clickstream_events(df: DataFrame) -> DataFrame:
    """Clickstream ``events(event_id, ts, user_id, event_type, value, props)``.

    The table has no session id; a session is one user's UTC day
    (``<user_id>-<yyyy-MM-dd>``), NULL when the user is unknown.
    """
    return df.select(
        F.col("ts").alias("event_time"),
        F.col("event_type"),
        F.col("event_id").alias("product_id"),
        F.col("value").cast("decimal(10,2)").alias("price"),
        F.col("user_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("user_session"),
    )


def order_events(df: DataFrame) -> DataFrame:
    """Orders as events: customer = user, order = session, status = event type."""
    return df.select(
        F.col("o_orderdate").alias("event_time"),
        F.col("o_orderstatus").alias("event_type"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("user_session"),
    )
