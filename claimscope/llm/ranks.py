"""Places of rows in an order, without sorting any group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import shared_table

PLACE_BITS = 33  # of a monotonically increasing id, the bits that count within a partition


def ranked(rows: DataFrame, group: str, order: Sequence[Column], label: str) -> DataFrame:
    """``rows`` with ``idx`` (place in its group in ``order``, from 0) and ``n`` (rows of the group).

    ``group`` must not be NULL. The rows are stored, dealt into ranges of group and order, and
    stored again in that order; a row's place is its place in its range plus what earlier
    ranges hold of its group. So a group with most of the rows spreads over many tasks. Equal
    rows are told apart by where they were stored, hence even they need not share a task.
    """
    stored = shared_table(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{label}-rows")
    keys = [F.col(group), *order, F.col("_tie")]
    lined = stored.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = shared_table(lined.withColumn("_at", F.monotonically_increasing_id()), f"{label}-sorted")
    placed = placed.withColumn("_part", F.shiftright("_at", PLACE_BITS))
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    # One row per group and range: at most as many as groups and ranges together.
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        group,
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
        F.sum("_rows").over(whole).alias("n"),
    )
    joined = placed.join(shared_table(bases, f"{label}-bases"), [group, "_part"])
    return joined.withColumn("idx", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base")
