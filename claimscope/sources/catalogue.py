"""Column types taken from a published field catalogue."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.operators.clean import conform, duplicate_keys, keep_first
from claimscope.sources.tables import stored

# --- fixed values: catalogue layout and type names ---------------------------
FIELD_LIST = "OpenFemaDataSetFields"
CATALOGUE_SCHEMA = f"{FIELD_LIST} array<struct<name:string,type:string,primaryKey:boolean>>"
TYPE_NAMES: dict[str, T.DataType] = {
    "text": T.StringType(),
    "datetime": T.TimestampNTZType(),
    "date": T.DateType(),
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
}
DEFAULT_DECIMAL = T.DecimalType(10, 0)


def spark_type(name: str) -> T.DataType:
    """Spark type of a catalogue type name; unknown names are text."""
    name = name.strip().lower()
    if "decimal" in name:
        digits = [int(d) for d in re.findall(r"\d+", name)]
        return T.DecimalType(*digits[:2]) if digits else DEFAULT_DECIMAL
    return TYPE_NAMES.get(name, T.StringType())


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per field: name, type, primaryKey."""
    raw = spark.read.schema(CATALOGUE_SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.inline(FIELD_LIST)).select(
        "name", "type", F.coalesce("primaryKey", F.lit(False)).alias("primaryKey")
    )


def catalogue_schema(catalogue: DataFrame) -> tuple[T.StructType, list[str]]:
    """Schema and key columns. Only the field list, one row per column, reaches the driver."""
    fields = catalogue.collect()
    schema = T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in fields])
    return schema, [f["name"] for f in fields if f["primaryKey"]]


def cast_by_catalogue(raw: DataFrame, catalogue: DataFrame, blank_numeric: str = "null") -> DataFrame:
    """Raw text columns cast to their catalogue types in one projection.

    A landing-order column, if there is one, passes through.
    """
    schema, _ = catalogue_schema(catalogue)
    return conform(raw, schema, blank_numeric)


@dataclass(frozen=True)
class Keyed:
    """A table cast by a catalogue, and what its key says about the rows.

    ``rows`` is the table; ``repeated`` has the key values that occur more than once, with
    their row counts; ``unkeyed`` the rows in which a key column is NULL. Both are empty
    where the catalogue names no key.
    """

    rows: DataFrame
    key: list[str]
    repeated: DataFrame
    unkeyed: DataFrame

    def refuse(self) -> DataFrame:
        """The rows; an error if a key repeats or is NULL."""
        repeats, missing = self.repeated.limit(1).count(), self.unkeyed.limit(1).count()
        if repeats or missing:
            raise KeyViolated(f"{', '.join(self.key)}: {'repeated' if repeats else 'NULL'} keys")
        return self.rows

    def first(self) -> DataFrame:
        """One row per key, the first landed where that is known; rows without a key go, as in a keyed load."""
        if not self.key:
            return self.rows
        known = reduce(and_, [F.col(f"`{k}`").isNotNull() for k in self.key])
        return keep_first(self.rows.where(known), self.key)


class KeyViolated(ValueError):
    """The rows break the key that the catalogue declares."""


def keyed_by_catalogue(raw: DataFrame, catalogue: DataFrame, blank_numeric: str = "null", store: bool = True) -> Keyed:
    """Rows cast by a catalogue, with its primary key as a constraint that can be looked at or heeded.

    Nothing is dropped unless asked for. Keys are compared after the cast, as a table's
    are. The cast rows are stored once, unless ``store`` is off, and counted there, on their
    key columns alone; a key with a third of all rows sends one row per task.
    """
    schema, key = catalogue_schema(catalogue)
    rows = conform(raw, schema, blank_numeric)
    rows = stored(rows, "keyed") if store and key else rows
    if not key:
        return Keyed(rows, key, rows.select(F.lit(0).cast("bigint").alias("rows")).limit(0), rows.limit(0))
    missing = reduce(or_, [F.col(f"`{k}`").isNull() for k in key])
    return Keyed(rows, key, duplicate_keys(rows.where(~missing), key), rows.where(missing))
