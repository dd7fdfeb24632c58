"""Every registered query equals its SQL oracle on the sf0.01 driver tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

from .conftest import SF001
from .oracle import compare, duck

pytestmark = pytest.mark.skipif(not os.path.isdir(SF001), reason="driver tables not present")

# the queries of the optional subpackage have tests of their own
OWN = set(entry.llm.queries()) if entry.llm else set()
QUERIES = {k: v for k, v in entry.queries().items() if k not in OWN}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k not in OWN}


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_parity(spark, con, name):
    ok, msg = compare(spark, con, name, QUERIES[name], ORACLES[name], SF001)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [r["step_no"] for r in sorted(rows, key=lambda r: r["step_no"])] == [1, 2, 3]
    assert df.columns == ["step_no", "step_name", "sessions", "micro_cr_pct", "macro_cr_pct", "sessions_lost", "drop_off_pct"]
