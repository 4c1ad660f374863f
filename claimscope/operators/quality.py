"""Counts, reconciliation, profiles and samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: name and row count."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def reconcile(landing: DataFrame, final: DataFrame) -> DataFrame:
    """Row counts of both tables side by side and their difference."""
    landed = landing.agg(F.count(F.lit(1)).alias("n")).scalar()
    return final.agg(F.count(F.lit(1)).alias("final_rows")).select(
        landed.alias("landing_rows"), "final_rows", (landed - F.col("final_rows")).alias("diff")
    )


def head(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows, as a look at a table: as many as asked for, in no order of their own."""
    return df.limit(rows)


def profile(df: DataFrame) -> DataFrame:
    """Type, non-NULL and NULL count of every column, in one pass over the table."""
    total = F.count(F.lit(1)).alias("_rows")
    counts = df.agg(total, *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    entries = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(dtype).alias("data_type"),
            F.col(f"`{name}`").alias("non_null"),
            (F.col("_rows") - F.col(f"`{name}`")).alias("nulls"),
        )
        for position, (name, dtype) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*entries)))


def draw(seed: int, columns: Sequence[str]) -> tuple[Column, Column]:
    """A number from 0 to 1 that follows from the seed and a row's cells, and the cells as text."""
    cells = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in columns])
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), cells)), 1, 13), 16, 10)
    return digits.cast("bigint").cast("double") / F.lit(float(1 << 52)), cells


MERGED_TASKS = 4096


def random_sample(df: DataFrame, rows: int, seed: int = 1, tasks: int = MERGED_TASKS) -> DataFrame:
    """Exactly ``rows`` rows (all, if there are fewer) in seeded random order, in one pass.

    A row's place follows from the seed and its cells, so neither the partitioning nor a
    retried task changes the sample; equal rows tie, and either may stand for the other.

    Each task holds the ``rows`` lowest of all it reads, whatever that is, and one last task
    merges them. Splits of the input are read in at most ``tasks`` groups, one after the
    other within a group: the merge then sees at most ``tasks * rows`` rows however large
    the table is, also where many rows are equal. A sample that is no small part of the
    table is better taken with ``DataFrame.sample``.
    """
    number, cells = draw(seed, df.columns)
    drawn = df.coalesce(tasks).select("*", number.alias("_draw"), cells.alias("_cells"))
    return drawn.orderBy("_draw", "_cells").limit(rows).drop("_draw", "_cells")
