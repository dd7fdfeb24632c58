"""Cart outcomes on fixture 1."""

from __future__ import annotations

from decimal import Decimal

import pytest

from eventscope.operators import cart_outcomes, cart_sessions
from eventscope.operators.carts import ENGLISH_OUTCOME_LABELS

from .conftest import as_dicts


def _by_outcome(df):
    out: dict[str, list[str]] = {}
    for r in as_dicts(df):
        out.setdefault(r["cart_outcome"], []).append(r["user_session"])
    return {k: sorted(v) for k, v in out.items()}


def test_outcome_per_session(session_events):
    cs = cart_sessions(session_events, labels=ENGLISH_OUTCOME_LABELS)
    assert _by_outcome(cs) == {
        "paid": ["A", "G", "J"],
        "removed": ["I", "K"],
        "abandoned": ["B", "C", "D", "E", "H", "M"],
    }
    prices = {r["user_session"]: r["cart_price"] for r in as_dicts(cs)}
    assert prices["C"] == Decimal("35.00") and prices["H"] is None


def test_report(session_events):
    out = as_dicts(cart_outcomes(cart_sessions(session_events, labels=ENGLISH_OUTCOME_LABELS)))
    assert [(r["cart_outcome"], r["sessions"], r["share_pct"], r["avg_cart_price"]) for r in out] == [
        ("abandoned", 6, Decimal("54.55"), Decimal("53.00")),
        ("paid", 3, Decimal("27.27"), Decimal("60.00")),
        ("removed", 2, Decimal("18.18"), Decimal("100.00")),
    ]


def test_default_labels_are_the_published_ones(session_events):
    labels = {r["cart_outcome"] for r in as_dicts(cart_outcomes(cart_sessions(session_events)))}
    assert labels == {"Оплачена", "Товар удалён из корзины", "Брошена без действий"}


def test_any_after_cart_only_changes_h(session_events):
    first = _by_outcome(cart_sessions(session_events, labels=ENGLISH_OUTCOME_LABELS))
    anyp = _by_outcome(cart_sessions(session_events, labels=ENGLISH_OUTCOME_LABELS, paid_rule="any_after_cart"))
    assert anyp["paid"] == ["A", "G", "H", "J"]
    assert anyp["abandoned"] == [s for s in first["abandoned"] if s != "H"]
    assert anyp["removed"] == first["removed"]


def test_bad_rule(session_events):
    with pytest.raises(ValueError):
        cart_sessions(session_events, paid_rule="whatever")
