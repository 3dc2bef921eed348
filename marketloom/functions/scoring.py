"""Decay, fit, normalisation and display formatting of scores and amounts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MICROS_PER_DAY = 86_400_000_000


def days_between(ts: Column, as_of: Column) -> Column:
    """Fractional days from `ts` to `as_of`, never negative."""
    return F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", ts, as_of) / F.lit(float(MICROS_PER_DAY)))


def time_decay(ts: Column, as_of: Column, lam: float = 0.05) -> Column:
    """exp(-lam * days); 1.0 when the time is unknown."""
    return F.coalesce(F.exp(F.lit(-lam) * days_between(ts, as_of)), F.lit(1.0))


def recency(ts: Column, as_of: Column, lam: float = 0.023, unknown: float = 0.5) -> Column:
    """Freshness of a listing with a half-life of about thirty days."""
    return F.coalesce(F.exp(F.lit(-lam) * days_between(ts, as_of)), F.lit(unknown))


def price_fit(price: Column, budget: Column) -> Column:
    """1.0 on budget, falling linearly to 0 at twice the budget; 1.0 when either side is unknown."""
    miss = F.abs(price - budget) / budget
    return F.when(budget.isNull() | (budget <= 0) | price.isNull(), 1.0).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.lit(1.0), miss))
    )


def normalize_by_max(score: Column, *partition: str) -> Column:
    """Score over the largest score of its request; 0 when no score is positive.

    For recall lists, whose length per request is bounded. Use
    `operators.recall.normalize` for lists of unbounded length.
    """
    top = F.max(score).over(Window.partitionBy(*partition))
    return F.when(top > 0, score / top).otherwise(0.0)


def warmup(n: Column, threshold: int = 20) -> Column:
    """0 without history, rising linearly to 1 at `threshold` events."""
    return F.least(F.lit(1.0), n / F.lit(float(max(1, threshold))))


def type_weight(kind: Column, weights: Mapping[str, float], default: float = 1.0) -> Column:
    """Weight of an event type, `default` for unlisted ones."""
    if not weights:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
    return F.coalesce(F.try_element_at(table, kind), F.lit(float(default)))


def grouped_number(col: Column, prefix: str = "", suffix: str = "") -> Column:
    """12345 -> '12,345' with optional currency or unit."""
    return F.concat(F.lit(prefix), F.format_number(col, 0), F.lit(suffix))


def mileage_text(col: Column) -> Column:
    return grouped_number(col, suffix=" mi.")


def price_text(col: Column) -> Column:
    return grouped_number(col, prefix="$")


def round_half_up(col: Column, digits: int = 0) -> Column:
    return F.round(col, digits)


def better_side(left: Column, right: Column, direction: str) -> Column:
    """'left' or 'right' for the better value, NULL when equal, missing or zero."""
    comparable = (F.coalesce(left, F.lit(0)) != 0) & (F.coalesce(right, F.lit(0)) != 0)
    first, second = (left, right) if direction == "lower" else (right, left)
    return F.when(comparable & (first < second), "left").when(comparable & (first > second), "right")


def changed(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)
