"""From raw text rows to typed, keyed tables: one lazy projection, no staging passes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope import schemas
from claimscope.functions.lenient import lenient
from claimscope.functions.text import blank_to_null, zip5
from claimscope.sources.delimited import LANDED


def conform(raw: DataFrame, schema: T.StructType, blank_numeric: str = "null") -> DataFrame:
    """Bind columns by name, in table order, with forgiving casts.

    A landing-order column, if there is one, passes through.
    """
    cells = [lenient(F.col(f"`{f.name}`"), f.dataType, blank_numeric).alias(f.name) for f in schema]
    return raw.select(*cells, *[c for c in raw.columns if c == LANDED])


def keep_first(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key: the first landed, where the landing order is known."""
    return keep_one(df, key, [c for c in df.columns if c == LANDED]).drop(LANDED)


def clean_claims(raw: DataFrame, blank_numeric: str = "null") -> DataFrame:
    """Typed claims in table order plus the derived postal code."""
    return with_clean_zip(conform(raw, schemas.CLAIMS, blank_numeric))


def with_clean_zip(claims: DataFrame) -> DataFrame:
    return claims.withColumn("clean_zip", zip5(F.col("reportedZipCode")))


# Typed rows of the keyed tables. Their keys repeat in the feeds; ``keep_first`` leaves one row
# of each, and reads its input three times: store the typed rows before.
CROSSWALK_KEY = ("zip_code",)
LAND_KEY = ("ZCTA20", "YEAR")
INDEX_KEY = ("observation_date",)


def typed_crosswalk(raw: DataFrame) -> DataFrame:
    """Blank areas become NULL."""
    return conform(raw, schemas.CROSSWALK).withColumn("zcta", blank_to_null(F.col("zcta")))


def typed_price_index(raw: DataFrame, blank_numeric: str = "null") -> DataFrame:
    return with_index_year(conform(raw, schemas.PRICE_INDEX_FILE, blank_numeric))


def clean_crosswalk(raw: DataFrame) -> DataFrame:
    """Blank areas become NULL; one row per postal code."""
    return keep_first(typed_crosswalk(raw), CROSSWALK_KEY)


def clean_land_cover(raw: DataFrame, blank_numeric: str = "null") -> DataFrame:
    """One row per area and year."""
    return keep_first(conform(raw, schemas.LAND_COVER, blank_numeric), LAND_KEY)


def clean_price_index(raw: DataFrame, blank_numeric: str = "null") -> DataFrame:
    """One row per observation date, with its year."""
    return keep_first(typed_price_index(raw, blank_numeric), INDEX_KEY)


def with_index_year(index: DataFrame) -> DataFrame:
    return index.withColumn("cpi_year", F.year("observation_date"))


def dates_or_null(raw: DataFrame, columns: Sequence[str] = schemas.CLAIM_DATES, to: T.DataType | None = None) -> DataFrame:
    """Impossible dates in the named text columns become NULL, in one projection."""
    typed = {c: lenient(F.col(c), to or schemas.CLAIMS[c].dataType) for c in columns}
    return raw.withColumns(typed)


def keep_one(df: DataFrame, key: Sequence[str], prefer: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``prefer``, then by all other columns.

    The keys are counted by hash, on the key columns alone. Rows whose key occurs once pass
    through; only the others go through a minimum over whole rows, which combines inside
    each task, so a key with a third of all rows sends one row per task. ``df`` is read
    three times; give a stored table if it is costly to compute. NULL is a key like others.
    """
    rest = [c for c in df.columns if c not in key and c not in prefer]
    if not [*prefer, *rest]:
        return df.select(*key).distinct()
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = repeated.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
    single = df.join(repeated, same, "left_anti")
    several = df.join(repeated, same, "left_semi").groupBy(*key).agg(F.min(F.struct(*prefer, *rest)).alias("_row"))
    return single.unionByName(several.select(*[F.col(c) if c in key else F.col(f"_row.{c}") for c in df.columns]))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
