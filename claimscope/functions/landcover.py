"""Land-cover classes as ordered rules over area shares."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimscope import constants as K


def share(columns: Sequence[str]) -> Column:
    """Sum of the named shares; NULL if any is NULL."""
    return reduce(add, [F.col(c) for c in columns])


@dataclass(frozen=True)
class Rule:
    """``label`` applies where the summed shares pass ``threshold``."""

    label: str
    shares: tuple[str, ...]
    threshold: str
    inclusive: bool = True

    def holds(self) -> Column:
        limit = F.lit(self.threshold).cast("decimal(15,13)")
        total = share(self.shares)
        return total >= limit if self.inclusive else total > limit


@dataclass(frozen=True)
class Scheme:
    """Rules tried in order; an area that passes none takes ``otherwise``."""

    rules: tuple[Rule, ...]
    otherwise: str

    def label(self) -> Column:
        out = F.lit(self.otherwise)
        for rule in reversed(self.rules):
            out = F.when(rule.holds(), F.lit(rule.label)).otherwise(out)
        return out


def concrete_or_natural(labels: Sequence[str], threshold: str) -> Scheme:
    """Three classes: mostly dense development, mostly natural, neither."""
    developed, natural, mixed = labels
    return Scheme(
        (Rule(developed, K.DENSE, threshold, False), Rule(natural, K.NATURAL, threshold, False)),
        mixed,
    )


COST_SCHEME = concrete_or_natural(K.COST_LABELS, "0.5")
FLOOD_TYPE_SCHEME = concrete_or_natural(K.FLOOD_TYPE_LABELS, "0.4")


def storm_scheme(wet: str = "0.25", half: str = "0.5") -> Scheme:
    """Six classes, wetland first."""
    wetland, dense, suburb, forest, farm, mixed = K.STORM_LABELS
    return Scheme(
        (
            Rule(wetland, K.WETLAND, wet),
            Rule(dense, K.DENSE, half),
            Rule(suburb, K.DEVELOPED, half),
            Rule(forest, K.WILDLAND, half),
            Rule(farm, K.FARMLAND, half),
        ),
        mixed,
    )


def severity_scheme(high: str = "0.5", developed: str = "0.5", wet: str = "0.5", forest: str = "0.5") -> Scheme:
    """Five classes, high-intensity development first."""
    concrete, suburb, swamp, wild, mixed = K.SEVERITY_LABELS
    return Scheme(
        (
            Rule(concrete, K.HIGH_INTENSITY, high),
            Rule(suburb, K.DEVELOPED, developed),
            Rule(swamp, K.WETLAND, wet),
            Rule(wild, K.WILDLAND, forest),
        ),
        mixed,
    )


def decile_percent(total_share: Column) -> Column:
    """A share rounded to the nearest ten percent: 0, 10 ... 100."""
    return (F.round(total_share * 10) * 10).cast("int")


def impervious_percent() -> Column:
    """Decile bucket of all developed land."""
    return decile_percent(share(K.DEVELOPED))


def density_band(bucket: Column) -> Column:
    """Low, medium or high band of a decile bucket."""
    low, medium, high = K.BAND_LABELS
    return (
        F.when(bucket <= K.LOW_BAND_MAX, F.lit(low))
        .when(bucket <= K.MEDIUM_BAND_MAX, F.lit(medium))
        .otherwise(F.lit(high))
    )
