"""Measures and grouped aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.constants import RATE_DIGITS, SEVERE_DEPTH_INCHES
from claimscope.functions.money import paid, quotient, total_paid

BUILDING = "amountPaidOnBuildingClaim"
CONTENTS = "amountPaidOnContentsClaim"


def claim_count() -> Column:
    return F.count("id")


def building_claim_count() -> Column:
    """Claims with an actual building payment."""
    return F.count_if(F.coalesce(F.col(BUILDING), F.lit(0)) > 0)


def building_paid() -> Column:
    return F.sum(paid(F.col(BUILDING)))


def nominal_paid() -> Column:
    return F.sum(total_paid(F.col(BUILDING), F.col(CONTENTS)))


def severe_count(depth: int = SEVERE_DEPTH_INCHES) -> Column:
    return F.count_if(F.col("waterDepth") >= depth)


def basement_count() -> Column:
    return F.count_if(F.col("waterDepth") < 0)


def primary_count() -> Column:
    return F.count_if(F.col("primaryResidenceIndicator"))


def rate(part: str, whole: str, digits: int = RATE_DIGITS) -> Column:
    """Share of two counted columns; NULL over zero."""
    return quotient(F.col(part), F.col(whole), digits)


def per_hundred(part: str, whole: str, digits: int = RATE_DIGITS) -> Column:
    """Occurrences per hundred units."""
    return (rate(part, whole, digits) * 100).cast(f"decimal(19,{digits})")


def by_zip(claims: DataFrame, keys: Sequence[str] = (), /, **measures: Column) -> DataFrame:
    """First level: claims summed per postal code and further keys.

    Every measure combines inside each task, so a hot postal code or storm sends one
    row per task into the shuffle.
    """
    return claims.groupBy("clean_zip", *keys).agg(*[m.alias(name) for name, m in measures.items()])


def roll_up(df: DataFrame, keys: Sequence[str | Column], *sums: str) -> DataFrame:
    """Second level: add up first-level sums under coarser keys."""
    return df.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def largest(df: DataFrame, keys: Sequence[str], text: str, to: str) -> DataFrame:
    """The last text in order per group.

    A maximum over text sorts its rows. Taking the distinct texts of each group first, by
    hash and inside each task, leaves a small summary to sort.
    """
    # The filter keeps the optimizer from taking the first level for redundant.
    texts = df.groupBy(*keys, text).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 0)
    return texts.groupBy(*keys).agg(F.max(text).alias(to))


def weighted_average(df: DataFrame, keys: Sequence[str], total: str, weight: str, to: str, digits: int = RATE_DIGITS) -> DataFrame:
    """Total over weight per group; 0 where the weight is not positive."""
    sums = df.groupBy(*keys).agg(F.sum(total).alias("_total"), F.sum(weight).alias("_weight"))
    scale = sums.schema["_total"].dataType.scale if sums.schema["_total"].dataType.typeName() == "decimal" else 0
    value = quotient(F.col("_total"), F.col("_weight"), digits, scale)
    zero = F.lit(0).cast(f"decimal({19 + digits},{digits})")
    return sums.select(*keys, F.when(F.col("_weight") > 0, value).otherwise(zero).alias(to))


# --- exact median ------------------------------------------------------------
# A bin is a range of values: first all with the same sign, magnitude and three leading
# digits, then a thousandth of the range that is left.
LEADING = 1000
STEPS = 1000


def _leading_digits(value: Column) -> Column:
    """A number that never falls while ``value`` rises: sign, magnitude and leading digits."""
    x = value.cast("double")
    size = F.abs(x)
    magnitude = F.greatest(F.floor(F.log10(size)), F.lit(-300))
    lead = F.floor(size / F.pow(F.lit(10.0), magnitude - 2))
    code = (magnitude + 400) * LEADING + lead
    infinite = F.lit(float("inf"))
    # NaN comes after all numbers, as in a sort.
    return (
        F.when(F.isnan(x), F.lit(1_000_000_000))
        .when(size == infinite, F.when(x > 0, F.lit(900_000_000)).otherwise(F.lit(-900_000_000)))
        .when(size == 0, F.lit(0))
        .when(x > 0, code)
        .otherwise(-code)
        .cast("bigint")
    )


def _step(value: Column, least: Column, most: Column) -> Column:
    """The place of a value between two others, in ``STEPS`` steps."""
    low, span = least.cast("double"), most.cast("double") - least.cast("double")
    return F.when((least == most) | (span == 0), F.lit(0)).otherwise(F.floor((value.cast("double") - low) / span * STEPS)).cast("bigint")


def _holders(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each group's bins the one that holds the row with rank ``_rank``, which then counts within it."""
    order = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = bins.withColumn("_upto", F.sum("_n").over(order))
    held = upto.filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
    return held.withColumn("_rank", F.col("_rank") - (F.col("_upto") - F.col("_n"))).drop("_upto", "_n")


def _in_bin(rows: DataFrame, bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the bins; compared so that no condition on the rows reaches their source."""
    on = [*keys, "_bin"]
    renamed = bins.select(*[F.col(c).alias(f"_of{c}" if c in on else c) for c in bins.columns])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in on])
    return rows.join(renamed, same).drop("_bin", *[f"_of{c}" for c in on])


def value_counts(df: DataFrame, key: str, value: str, *others: str) -> DataFrame:
    """How often each value occurs per key: the form from which medians and totals are taken.

    The count combines inside each task and is the only shuffle of rows, spread by key and
    value. All that is taken from it in one plan shares that shuffle, so ``df`` is computed
    once. ``others`` are further columns to count by.
    """
    return df.groupBy(key, value, *others).agg(F.count(F.lit(1)).alias("rows"))


def median_of_counts(counted: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """Exact median per key, by rank, from :func:`value_counts`; nothing runs until it is read.

    The counts are summed per bin of leading digits, a few thousand bins per key at most; a
    running sum over these finds the bins that hold the two middle ranks. Their values are
    binned once more, more finely, and only the values of one such bin are looked at one by
    one. No key's values meet in one task. NULL keys and values do not count.
    """
    # A filter would reach the rows below the count, which totals could then not share.
    present = F.when(F.col(key).isNotNull() & F.col(value).isNotNull(), F.col("rows")).otherwise(F.lit(0))
    first = counted.select(F.col(key).alias("_key"), F.col(value).alias("_value"), present.alias("_n")).withColumn("_bin", _leading_digits(F.col("_value")))
    extent = (F.sum("_n").alias("_n"), F.min("_value").alias("_least"), F.max("_value").alias("_most"))
    bins = first.groupBy("_key", "_bin").agg(*extent)
    size = F.sum("_n").over(Window.partitionBy("_key"))
    middles = F.array(*[F.struct(F.lit(k).alias("_end"), F.expr(rank).alias("_rank")) for k, rank in enumerate(("(_size + 1) div 2", "_size div 2 + 1"))])
    ranked = bins.withColumn("_size", size).select("_key", "_bin", "_n", "_least", "_most", F.inline(middles))
    near = _in_bin(first, _holders(ranked, ["_key", "_end"]), ["_key"])
    near = near.withColumn("_bin", _step(F.col("_value"), F.col("_least"), F.col("_most"))).drop("_least", "_most")
    finer = near.groupBy("_key", "_end", "_bin").agg(F.sum("_n").alias("_n"), F.max("_rank").alias("_rank"))
    left = _in_bin(near.drop("_rank"), _holders(finer, ["_key", "_end"]), ["_key", "_end"])
    # What shares a bin now: the few different values within a millionth of a power of ten.
    values = left.select("_key", "_end", "_rank", "_n", F.col("_value").alias("_bin"))
    ends = _holders(values, ["_key", "_end"])
    # The key as a measure, so that no condition on it reaches the rows either.
    return (
        ends.groupBy("_key")
        .agg(F.max("_key").alias(key), F.min("_bin").alias("_a"), F.max("_bin").alias("_b"))
        .select(key, ((F.col("_a") + F.col("_b")) / 2).alias(to))
    )


def exact_median(df: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """Exact median per key; ``df`` is computed once."""
    return median_of_counts(value_counts(df, key, value), key, value, to)
