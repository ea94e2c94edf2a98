"""Lower bound of the Wilson score interval for a proportion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.96


def wilson_lower(pos: Column, total: Column, z: float = Z_95, digits: int = 4) -> Column:
    """Wilson lower bound of ``pos / total``; 0.0 without trials, null for null input.

    ``pos`` may exceed ``total`` (more purchases than views), so the bound is not
    clamped at 1; the term under the root is clamped at 0. The outer ``greatest``
    turns the -0.0 of a zero proportion into 0.0.
    """
    n = F.nullif(total, F.lit(0)).cast("double")
    p = pos.cast("double") / n
    z2 = F.lit(z * z)
    spread = F.greatest(F.lit(0.0), p * (F.lit(1.0) - p) / n + z2 / (F.lit(4.0) * n * n))
    centre = p + z2 / (F.lit(2.0) * n)
    bound = (centre - F.lit(z) * F.sqrt(spread)) / (F.lit(1.0) + z2 / n)
    # greatest() skips nulls, so a null count is let through before it.
    return F.when(total.isNull() | pos.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(total == 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.round(bound, digits))
        )
    )
