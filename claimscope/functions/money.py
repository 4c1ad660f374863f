"""Money and ratio arithmetic in exact decimals.

Sums of doubles depend on the order in which partitions arrive, so a retried task
can change the last digits. Decimals do not: every total and quotient below is the
same whatever the partitioning, and quotients are rounded half-up at a stated number of
digits (beyond nineteen decimals the division itself has cut first).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimscope.constants import RATIO_DIGITS, REAL_DIGITS

# The precise ratio keeps 14 decimals; 19 + 18 digits then multiply without loss.
PRECISE_RATIO_DIGITS = 14


def paid(amount: Column) -> Column:
    """A payment with NULL and negative (returned or uncashed) amounts counted as zero."""
    return F.greatest(F.coalesce(amount, F.lit(0).cast("decimal(12,2)")), F.lit(0).cast("decimal(12,2)"))


def total_paid(building: Column, contents: Column) -> Column:
    """Building plus contents, each floored at zero on its own."""
    return paid(building) + paid(contents)


def at_least(count: Column, floor: int = 1) -> Column:
    """A count with NULL and anything below ``floor`` raised to ``floor``."""
    return F.greatest(F.coalesce(count, F.lit(floor)), F.lit(floor))


def quotient(numerator: Column, denominator: Column, digits: int, scale: int = 0) -> Column:
    """Exact ``numerator / denominator`` rounded to ``digits``; NULL over zero.

    ``scale`` is the number of decimals the numerator carries; the denominator is a
    whole number.
    """
    top = numerator.cast(f"decimal({19 + scale},{scale})")
    bottom = denominator.cast("decimal(19,0)")
    return F.round(F.try_divide(top, bottom), digits).cast(f"decimal({19 + digits},{digits})")


def price_ratio(base: Column, current: Column, digits: int = PRECISE_RATIO_DIGITS) -> Column:
    """How many base-year dollars one current dollar is worth; NULL when the index is zero
    or so near zero that the ratio passes what its digits hold."""
    ratio = F.round(F.try_divide(base.cast("decimal(14,7)"), current.cast("decimal(14,7)")), digits)
    # An index so close to zero that the ratio has no meaning counts as zero, in its year only.
    return ratio.try_cast(f"decimal(18,{digits})")


def restated(nominal: Column, ratio: Column, digits: int = REAL_DIGITS) -> Column:
    """A nominal amount at base-year prices."""
    amount = nominal.cast("decimal(19,2)") * ratio
    return F.round(amount, digits).cast(f"decimal({19 + digits},{digits})")


def reported_ratio(base: Column, current: Column) -> Column:
    """The ratio as the per-group reports publish it, at seven decimals."""
    return price_ratio(base, current, RATIO_DIGITS)
