"""Weighted popularity."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# A view counts 1, a cart 5, a purchase 10; the divisor is their sum.
WEIGHTS = (1, 5, 10)


def weighted_score(
    pv: Column, cart: Column, buy: Column, weights: tuple[int, int, int] = WEIGHTS
) -> Column:
    """Weighted mean of three counters, two decimals half-up, as double.

    The division is decimal, so that rounding sees the exact value and not a binary one.
    """
    w_pv, w_cart, w_buy = weights
    total = pv * F.lit(w_pv) + cart * F.lit(w_cart) + buy * F.lit(w_buy)
    divisor = F.lit(Decimal(f"{sum(weights)}.0"))
    return F.round(total / divisor, 2).cast("double")
