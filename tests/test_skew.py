"""A session holding a third of all rows: results stay exact and AQE splits the join."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from eventscope.operators import cart_sessions, funnel_sessions
from eventscope.operators.carts import ENGLISH_OUTCOME_LABELS

from .conftest import as_dicts, events_df

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _rows(seed=3):
    rng = random.Random(seed)
    base = dt.datetime(2024, 3, 1)
    rows = []
    kinds = ["view", "cart", "purchase", "remove_from_cart"]
    for s in range(400):
        for _ in range(rng.randint(1, 6)):
            rows.append((base + dt.timedelta(seconds=rng.randint(0, 3600)), rng.choice(kinds), 5, s, f"s{s}"))
    # the hot session: as many rows as all the others together, half of all rows
    hot = len(rows)
    for _ in range(hot):
        rows.append((base + dt.timedelta(seconds=rng.randint(0, 3600)), rng.choice(kinds), 7, 9999, "hot"))
    return rows


def _brute_funnel(rows):
    by = {}
    for t, k, _, _, s in rows:
        by.setdefault(s, []).append((t, k))
    out = {}
    for s, evs in by.items():
        views = [t for t, k in evs if k == "view"]
        if not views:
            continue
        v = min(views)
        carts = [t for t, k in evs if k == "cart" and t > v]
        c = min(carts) if carts else None
        buys = [t for t, k in evs if k == "purchase" and c is not None and t > c]
        out[s] = (v, c, min(buys) if buys else None)
    return out


def test_hot_session_funnel_exact_and_split(spark, skew_conf):
    rows = _rows()
    ev = events_df(spark, rows).repartition(16)
    fs = funnel_sessions(ev)
    got = {r["user_session"]: (r["viewed_at"], r["carted_at"], r["purchased_at"]) for r in as_dicts(fs)}
    assert got == _brute_funnel(rows)
    plan = fs._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan, plan


def test_hot_session_carts_exact(spark, skew_conf):
    rows = _rows(5)
    ev = events_df(spark, rows).repartition(16)
    got = {r["user_session"]: r["cart_outcome"] for r in as_dicts(cart_sessions(ev, labels=ENGLISH_OUTCOME_LABELS))}
    by = {}
    for t, k, _, _, s in rows:
        by.setdefault(s, []).append((t, k))
    want = {}
    for s, evs in by.items():
        carts = [t for t, k in evs if k == "cart"]
        if not carts:
            continue
        c = min(carts)
        buys = [t for t, k in evs if k == "purchase"]
        if buys and min(buys) > c:
            want[s] = "paid"
        elif any(k == "remove_from_cart" for _, k in evs):
            want[s] = "removed"
        else:
            want[s] = "abandoned"
    assert got == want


def test_hot_user_cohorts_exact(spark, skew_conf):
    from eventscope.operators import cohort_activity, retention_long

    rng = random.Random(11)
    rows = []
    for u in range(200):
        for _ in range(rng.randint(1, 4)):
            rows.append((dt.datetime(2024, rng.randint(1, 6), rng.randint(1, 28)), "view", 1, u, f"s{u}"))
    rows += [(dt.datetime(2024, rng.randint(2, 6), rng.randint(1, 28)), "view", 1, 9999, "hot") for _ in range(len(rows))]
    ev = events_df(spark, rows).repartition(16)
    months = {}
    for t, _, _, u, _ in rows:
        months.setdefault(u, set()).add(t.month)
    got = {(r["user_id"], r["month_num"]) for r in as_dicts(cohort_activity(ev))}
    assert got == {(u, m - min(ms)) for u, ms in months.items() for m in ms}
    first = {r["cohort_month"].month: r["total_users"] for r in as_dicts(retention_long(cohort_activity(ev))) if r["month_num"] == 0}
    sizes = {}
    for ms in months.values():
        sizes[min(ms)] = sizes.get(min(ms), 0) + 1
    assert first == sizes
