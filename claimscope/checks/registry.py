"""Registry of every query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.checks import expression_checks, load_checks, report_checks, set_checks
from claimscope.checks.standins import Standins

MODULES = (load_checks, expression_checks, set_checks, report_checks)


def presentable(df: DataFrame) -> DataFrame:
    """Decimals as doubles of at most four digits, small integers as int: types and values
    both engines can state alike. The library itself keeps every digit."""
    out = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind == "decimal":
            column = F.round(column, 4).cast("double")
        elif kind in ("byte", "short"):
            column = column.cast("int")
        out.append(column.alias(field.name))
    return df.select(*out)


@lru_cache(maxsize=8)
def standins(spark: SparkSession, sf_dir: str) -> Standins:
    """Stand-ins are lazy plans; building them once per session saves reading footers again."""
    return Standins(spark, sf_dir)


def _all():
    for module in MODULES:
        yield from module.checks()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: presentable(build(standins(spark, sf_dir)))

    return {name: bind(build) for name, build, _ in _all()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _all() if sql}
