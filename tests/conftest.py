from __future__ import annotations

import datetime as dt
import os
import shutil
import sys
import tempfile
import time
from decimal import Decimal

import pytest

# Naive fixture datetimes are UTC wall-clock times.
os.environ["TZ"] = "UTC"
time.tzset()

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from eventscope.plans.session import configure  # noqa: E402
from eventscope.sources.events import EVENT_SCHEMA  # noqa: E402

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="shared-")
    session = (
        SparkSession.builder.master("local[*]")
        .appName("eventscope-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    configure(session)
    yield session
    shutil.rmtree(shared, ignore_errors=True)


def ts(day: str, clock: str) -> dt.datetime:
    """``ts("01-10", "10:01")`` -> 2024-01-10 10:01 (fractional seconds allowed)."""
    return dt.datetime.fromisoformat(f"2024-{day} {clock if clock.count(':') == 2 else clock + ':00'}")


def events_df(spark, rows):
    """rows: (event_time, event_type, price, user_id, user_session)."""
    full = [
        (t, kind, None, None, None, None, None if price is None else Decimal(str(price)), user, session)
        for t, kind, price, user, session in rows
    ]
    return spark.createDataFrame(full, EVENT_SCHEMA)


D = "01-10"

# Fixture 1 (FIXTURES.md): sessions A..M and a NULL session, one user each.
SESSION_ROWS = [
    (ts(D, "10:00"), "view", 10, 1, "A"), (ts(D, "10:01"), "cart", 10, 1, "A"), (ts(D, "10:05"), "purchase", 10, 1, "A"),
    (ts(D, "10:00"), "cart", 20, 2, "B"), (ts(D, "10:01"), "view", 20, 2, "B"),
    (ts(D, "10:00"), "cart", 30, 3, "C"), (ts(D, "10:01"), "view", 30, 3, "C"), (ts(D, "10:02"), "cart", 35, 3, "C"),
    (ts(D, "10:00"), "view", 40, 4, "D"), (ts(D, "10:00"), "cart", 40, 4, "D"),
    (ts(D, "10:00"), "view", 50, 5, "E"), (ts(D, "10:01"), "cart", 50, 5, "E"), (ts(D, "10:01"), "purchase", 50, 5, "E"),
    (ts(D, "10:00"), "view", 60, 6, "F"), (ts(D, "10:01"), "purchase", 60, 6, "F"),
    (ts(D, "10:00"), "cart", 70, 7, "G"), (ts(D, "10:01"), "purchase", 70, 7, "G"),
    (ts(D, "10:00"), "purchase", 80, 8, "H"), (ts(D, "10:01"), "cart", None, 8, "H"), (ts(D, "10:02"), "purchase", 80, 8, "H"),
    (ts(D, "10:00"), "view", 90, 9, "I"), (ts(D, "10:01"), "cart", 90, 9, "I"), (ts(D, "10:02"), "remove_from_cart", 90, 9, "I"),
    (ts(D, "10:00"), "view", 100, 10, "J"), (ts(D, "10:01"), "cart", 100, 10, "J"),
    (ts(D, "10:02"), "remove_from_cart", 100, 10, "J"), (ts(D, "10:03:30"), "purchase", 100, 10, "J"),
    (ts(D, "10:00"), "remove_from_cart", 110, 11, "K"), (ts(D, "10:01"), "cart", 110, 11, "K"),
    (ts("01-31", "23:59:50"), "view", 120, 12, "M"), (ts("02-01", "00:00:10.5"), "cart", 120, 12, "M"),
    (ts(D, "10:00"), "view", 130, 13, None), (ts(D, "10:01"), "cart", 130, 13, None),
]

# Fixture 2: one event on the 15th of each listed month of 2024.
COHORT_USERS = {1: (1, 2, 3), 2: (1, 3), 3: (1,), 4: (2,), 5: (2, 3), 6: (3,), 7: (4,), None: (1,)}


@pytest.fixture(scope="session")
def session_events(spark):
    return events_df(spark, SESSION_ROWS)


@pytest.fixture(scope="session")
def cohort_events(spark):
    rows = [
        (dt.datetime(2024, m, 15, 12, 0), "view", 1, user, f"{user}-{m}")
        for user, months in COHORT_USERS.items()
        for m in months
    ]
    return events_df(spark, rows)


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


__all__ = ["SF001", "T", "as_dicts", "events_df", "ts"]
