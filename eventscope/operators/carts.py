"""Cart outcomes per session: paid, removed from cart, or abandoned.

One grouped aggregate by session computes every per-session fact with
conditional aggregates, so a hot session is reduced map-side before the
shuffle; the outcome report then aggregates at most three rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import pct

# Outcome labels of the published report, highest priority first.
CART_OUTCOME_LABELS = {
    "paid": "Оплачена",
    "removed": "Товар удалён из корзины",
    "abandoned": "Брошена без действий",
}
ENGLISH_OUTCOME_LABELS = {"paid": "paid", "removed": "removed", "abandoned": "abandoned"}

PAID_RULES = ("first_purchase", "any_after_cart")


def cart_sessions(
    events: DataFrame,
    *,
    cart: str = "cart",
    purchase: str = "purchase",
    removal: str = "remove_from_cart",
    session: str = "user_session",
    time: str = "event_time",
    event_type: str = "event_type",
    price: str = "price",
    paid_rule: str = "first_purchase",
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Per-session cart facts and outcome for sessions with at least one cart.

    Columns: ``user_session, carted_at, purchased_at, removals, cart_price,
    cart_outcome``. ``carted_at`` is the first cart, ``cart_price`` the highest
    single cart price, ``removals`` counts removals at any time.

    ``paid_rule="first_purchase"`` (default) compares the session's *first*
    purchase with the first cart, so purchase -> cart -> purchase is not paid;
    ``"any_after_cart"`` counts any purchase after the first cart (the latest
    purchase is then the one compared).
    """
    if paid_rule not in PAID_RULES:
        raise ValueError(f"paid_rule must be one of {PAID_RULES}")
    labels = labels or CART_OUTCOME_LABELS
    t, kind = F.col(time), F.col(event_type)
    purchase_time = F.when(kind == purchase, t)
    facts = (
        events.where(F.col(session).isNotNull() & kind.isin(cart, purchase, removal))
        .groupBy(F.col(session).alias(session))
        .agg(
            F.min(F.when(kind == cart, t)).alias("carted_at"),
            (F.min(purchase_time) if paid_rule == "first_purchase" else F.max(purchase_time)).alias("purchased_at"),
            F.count_if(kind == removal).alias("removals"),
            F.max(F.when(kind == cart, F.col(price))).alias("cart_price"),
            F.count_if(kind == cart).alias("_carts"),
        )
        .where(F.col("_carts") > 0)
    )
    outcome = (
        F.when(F.col("purchased_at").isNotNull() & (F.col("purchased_at") > F.col("carted_at")), F.lit(labels["paid"]))
        .when(F.col("removals") > 0, F.lit(labels["removed"]))
        .otherwise(F.lit(labels["abandoned"]))
    )
    return facts.select(session, "carted_at", "purchased_at", "removals", "cart_price", outcome.alias("cart_outcome"))


def cart_outcomes(sessions: DataFrame) -> DataFrame:
    """Report: ``cart_outcome, sessions, share_pct, avg_cart_price``, most sessions first.

    The share window runs over the (at most three) grouped rows only.
    """
    grouped = sessions.groupBy("cart_outcome").agg(
        F.count(F.lit(1)).alias("sessions"),
        # exact decimal mean: sum / count, rounded once
        F.round(F.sum("cart_price") / F.nullif(F.count("cart_price"), F.lit(0)), 2).alias("avg_cart_price"),
    )
    total = F.sum("sessions").over(Window.partitionBy())
    return grouped.select(
        "cart_outcome", "sessions", pct(F.col("sessions"), total).alias("share_pct"), "avg_cart_price"
    ).orderBy(F.desc("sessions"), "cart_outcome")
