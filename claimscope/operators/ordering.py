"""Orders and top keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.operators.joins import keep_members


def declared_rank(column: str, order: Sequence[str]) -> Column:
    """Position of a value in a declared order; NULL for values outside it."""
    return F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column)), F.lit(0))


def in_declared_order(df: DataFrame, column: str, order: Sequence[str], *then: str) -> DataFrame:
    """Only the declared values, sorted as declared, then by ``then``.

    Without ``then`` the rows of one value end up in one task; name columns that tell them
    apart wherever there may be many.
    """
    return df.filter(F.col(column).isin(list(order))).orderBy(declared_rank(column, order), *then)


def top_keys(df: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """The ``n`` keys with the largest totals; ties go to the smaller key.

    Sort plus limit keeps ``n`` rows per task, not a full sort.
    """
    totals = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(measure).alias(measure))
    return totals.orderBy(F.desc(measure), F.asc(key)).limit(n)


def rows_of_top_keys(df: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """Detail rows of the ``n`` largest keys."""
    return keep_members(df, top_keys(df, key, measure, n), key)
