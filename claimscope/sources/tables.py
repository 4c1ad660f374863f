"""Columnar tables and their on-disk layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.session import scratch_path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A whole Parquet table; Spark prunes columns and partitions per query."""
    return spark.read.parquet(path)


def write_sorted(df: DataFrame, path: str, key: str, partitions: int | None = None) -> str:
    """Write in global ``key`` order, in files of even size.

    A hash of the whole row breaks ties, so rows sharing one hot key still spread over
    several range partitions instead of filling one task, and equal rows by their landing
    position, which is the same in a retried task wherever ``df`` reads files.
    """
    landed = df.withColumn("_print", F.xxhash64(*df.columns)).withColumn("_landed", F.monotonically_increasing_id())
    order = [key, "_print", "_landed"]
    ranged = landed.repartitionByRange(partitions, *order) if partitions else landed.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).drop("_print", "_landed").write.parquet(path)
    return path


def write_by_year(df: DataFrame, path: str, year: str = "yearOfLoss", then_by: Sequence[str] = ("clean_zip",)) -> str:
    """Partition a claims table by year, with postal codes together inside each file.

    Filters on year prune folders, and sorted codes let the first aggregation of every
    report shrink its input before any shuffle. The rebalance hint lets the adaptive
    planner split a year that holds a third of all rows over many writers and merge
    small years, so neither one huge task nor a flood of tiny files results.
    """
    (
        df.hint("rebalance", year)
        .sortWithinPartitions(year, *then_by)
        .write.partitionBy(year)
        .parquet(path)
    )
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back.

    For results that several later steps read: nothing is computed twice, and a lost
    executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return read_table(df.sparkSession, path)
