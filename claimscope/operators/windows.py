"""Window steps. Partitions are bounded: years per area, or classes of a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.functions.money import quotient


def share_of_total(df: DataFrame, value: str, within: str, to: str, digits: int = 1) -> DataFrame:
    """Percent that a row holds of its partition's total."""
    total = F.sum(value).over(Window.partitionBy(within))
    return df.withColumn(to, quotient(F.col(value) * 100, total, digits))


def previous_year_value(land: DataFrame, value: Column, years: Sequence[int], to: str, previous: str) -> DataFrame:
    """A land measure and its value in the preceding one of the chosen years, per area."""
    chosen = land.filter(F.col("YEAR").isin(list(years))).select("ZCTA20", "YEAR", value.alias(to))
    per_area = Window.partitionBy("ZCTA20").orderBy("YEAR")
    return chosen.withColumn(previous, F.lag(to).over(per_area))
