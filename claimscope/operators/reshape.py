"""Long to wide.

Column values are given, so that the schema does not depend on the data and nothing runs
until the result is read, or all those that occur become columns. Then the cells are
computed and stored when the matrix is built, as one map per row, and its columns are the
keys of these maps: the input is computed once. A given list that misses a value is an
error, not a gap. Rows with NULL in the column of values have no cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.sources.tables import stored


def only_known(column: str, values: Sequence) -> Column:
    """The column; a value outside ``values`` stops the query."""
    name = F.col(f"`{column}`")
    message = F.concat(F.lit(f"{column} has a value that is not listed: "), name.cast("string"))
    return F.when(name.isNull() | name.isin(list(values)), name).otherwise(F.raise_error(message))


def _wide(df: DataFrame, rows: str, columns: str, values: Sequence, measures: dict[str, Column]) -> DataFrame:
    named = [m.alias(name) for name, m in measures.items()]
    return df.withColumn(columns, only_known(columns, values)).groupBy(rows).pivot(columns, list(values)).agg(*named)


def _wide_as_found(df: DataFrame, rows: str, columns: str, measures: dict[str, Column]) -> DataFrame:
    """A column for every value that occurs, in order; as many as Spark's own pivot allows."""
    column = F.col(f"`{columns}`")
    cells = df.groupBy(F.col(f"`{rows}`").alias("_row"), column.alias("_column")).agg(
        F.struct(*[m.alias(name) for name, m in measures.items()]).alias("_cell")
    )
    # A map holds one entry per column of the matrix.
    entry = F.when(F.col("_column").isNotNull(), F.struct("_column", "_cell"))
    maps = stored(cells.groupBy("_row").agg(F.map_from_entries(F.collect_list(entry)).alias("_cells")), "matrix")
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    keys = maps.select(F.explode(F.map_keys("_cells")).alias("value")).distinct()
    found = keys.select("value", F.col("value").cast("string").alias("name")).orderBy("value").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{columns} has more than {most} values (spark.sql.pivotMaxValues)")
    wide = [
        F.col("_cells")[F.lit(f["value"]).cast(keys.schema["value"].dataType)][name].alias(
            f["name"] if len(measures) == 1 else f"{f['name']}_{name}"
        )
        for f in found
        for name in measures
    ]
    return maps.select(F.col("_row").alias(rows), *wide)


def _matrix(df: DataFrame, rows: str, columns: str, values: Sequence | None, measures: dict[str, Column]) -> DataFrame:
    if values is None:
        return _wide_as_found(df, rows, columns, measures)
    return _wide(df, rows, columns, values, measures)


def pivot_cells(df: DataFrame, rows: str, columns: str, values: Sequence | None, cell: str) -> DataFrame:
    """Matrix of single cells. Absent cells are NULL; two rows for one cell are an error."""
    clash = F.raise_error(F.lit(f"more than one row for a cell of {rows} by {columns}"))
    only = F.when(F.count(F.lit(1)) > 1, clash.cast(df.schema[cell].dataType)).otherwise(F.max(f"`{cell}`"))
    return _matrix(df, rows, columns, values, {cell: only})


def pivot_mean(df: DataFrame, rows: str, columns: str, values: Sequence | None, *cells: str) -> DataFrame:
    """Matrix of means; of several cells, with columns named ``value_cell``."""
    return _matrix(df, rows, columns, values, {c: F.avg(f"`{c}`") for c in cells})
