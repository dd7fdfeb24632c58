"""Distributed exact PERCENTILE_CONT against numpy's linear interpolation."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventscope.functions import quantiles
from eventscope.functions.quantiles import Range, exact_percentiles


@pytest.mark.parametrize("limit,sketch_size", [(100_000, 4096), (500, 400)])
def test_matches_numpy(spark, limit, sketch_size):
    rng = np.random.default_rng(7)
    a = rng.exponential(100.0, 5000).round(3)
    b = np.concatenate([np.full(2000, 60.0), rng.integers(0, 50, 1000).astype(float)])  # heavy ties
    rows = [(float(x), float(y) if i < len(b) else None) for i, (x, y) in enumerate(zip(a, np.resize(b, len(a))))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(7)
    probs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    targets = [(f"a_{i}", "a", p) for i, p in enumerate(probs)] + [(f"b_{i}", "b", p) for i, p in enumerate(probs)]
    r = exact_percentiles(df, targets, limit=limit, sketch_size=sketch_size).first()
    bvals = np.array([y for _, y in rows if y is not None])
    for i, p in enumerate(probs):
        assert r[f"a_{i}"] == pytest.approx(float(np.quantile(a, p)), rel=0, abs=1e-9)
        assert r[f"b_{i}"] == pytest.approx(float(np.quantile(bvals, p)), rel=0, abs=1e-9)
    assert r["n_a"] == len(a) and r["n_b"] == len(bvals)


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    r = exact_percentiles(df, [("m", "x", 0.5)]).first()
    assert r["m"] is None and r["n_x"] == 0
    one = spark.range(1).select(F.lit(3.5).alias("x"))
    assert exact_percentiles(one, [("m", "x", 0.9)]).first()["m"] == 3.5


def test_rejects_bad_probability(spark):
    with pytest.raises(ValueError):
        exact_percentiles(spark.range(3), [("m", "id", 1.5)])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.integers(0, 20).map(float), st.floats(0, 1000, allow_nan=False)), min_size=200, max_size=400),
    st.lists(st.sampled_from([0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]), min_size=1, max_size=4, unique=True),
)
def test_small_sketches_and_many_rounds_are_exact(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    targets = [(f"q{i}", "x", p) for i, p in enumerate(probs)]
    r = exact_percentiles(df, targets, limit=40, sketch_size=32).first()
    for i, p in enumerate(probs):
        assert r[f"q{i}"] == pytest.approx(float(np.quantile(values, p)), rel=0, abs=1e-9)


def test_two_million_distinct_values(spark):
    """Ranks of x -> x ** 2 over a shuffled range are known; the same method as for small inputs."""
    n = 2_000_001
    df = spark.range(0, n, 1, 6).select((F.col("id").cast("double") * F.col("id")).alias("x"))
    r = exact_percentiles(df, [("a", "x", 0.5), ("b", "x", 0.9), ("c", "x", 0.123456)]).first()
    exact = lambda p: np.interp(p * (n - 1), [int(p * (n - 1)), int(p * (n - 1)) + 1], [float(int(p * (n - 1))) ** 2, float(int(p * (n - 1)) + 1) ** 2])
    assert r["n_x"] == n
    assert r["a"] == exact(0.5) and r["b"] == exact(0.9)
    assert r["c"] == pytest.approx(exact(0.123456), rel=1e-12)


def test_wide_and_tiny_values(spark):
    values = [1e300, -1e300, 1e-300, 0.0, -0.5, 2.0, 2.0, 3.5, 1e17, 1e17 + 16]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.2, 0.45, 0.5, 0.8, 1.0]
    r = exact_percentiles(df, [(f"q{i}", "x", p) for i, p in enumerate(probs)], limit=3, sketch_size=16).first()
    for i, p in enumerate(probs):
        assert r[f"q{i}"] == pytest.approx(float(np.quantile(values, p)), rel=1e-12)


def test_heavy_tail_leaves_no_task_more_than_the_limit(spark):
    """One huge value among two million distinct ones, and one value that half of the rows share."""
    n = 2_000_001
    x = F.when(F.col("id") == 0, F.lit(1e18)).otherwise(F.sqrt(F.col("id").cast("double")))
    rows = spark.range(0, n, 1, 6).select(x.alias("x0"), F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.col("id") % 99_991).cast("double").alias("x1"))
    wanted = {t: Range(t % 2, float("-inf"), float("inf"), n, int(p * (n - 1))) for t, p in enumerate([0.5, 0.5, 0.9, 0.2, 0.999999, 0.0001])}
    found, left, rounds = quantiles._rounds(rows, dict(wanted), 20_000, 1024)
    assert set(found) | set(left) == set(wanted) and rounds <= 3
    assert all(r.rows <= 20_000 and r.rank < r.rows for r in left.values())
    assert any(v == 7.0 for t, v in found.items() if t % 2)
    targets = [("a", "x0", 0.5), ("b", "x0", 0.9), ("c", "x0", 1.0), ("d", "x1", 0.5), ("e", "x1", 0.2)]
    r = exact_percentiles(rows, targets, limit=20_000, sketch_size=1024).first()
    assert r["a"] == pytest.approx((1_000_001) ** 0.5, rel=1e-15) and r["b"] == pytest.approx(1_800_001 ** 0.5, rel=1e-15) and r["c"] == 1e18
    other = np.sort(np.where(np.arange(n) % 2 == 0, 7.0, np.arange(n) % 99_991))
    assert r["d"] == other[(n - 1) // 2] and r["e"] == pytest.approx(float(np.quantile(other, 0.2)), rel=1e-12)


def test_nan_is_no_value_and_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 1), (4.0, 1), (None, 1)], "x double, t int")
    r = exact_percentiles(df, [("m", "x", 0.5)]).first()
    assert (r["m"], r["n_x"]) == (3.0, 2)
