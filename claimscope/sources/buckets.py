"""Tables laid out in buckets of a key, so that grouping and joining by it moves no rows.

A bucket is read by one task, however large. So a key that holds a great part of all rows
must not be bucketed: the sizes are counted before anything is written, and uneven buckets
are refused. Claims with such a postal code keep the layout by year, whose first-level sums
leave each task as one row per code.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = "_layout"  # a name that readers of the table pass over
MOST = 4.0  # times the average that the largest bucket may hold
SMALL_BUCKET = 100_000  # rows that never make buckets uneven


class UnevenBuckets(ValueError):
    """One bucket would hold far more rows than the others."""


@dataclass(frozen=True)
class Layout:
    """How a table is bucketed; kept beside its files, as they do not say so."""

    key: str
    buckets: int
    sort: tuple[str, ...]
    folders: str | None


def bucket_of(key: str, buckets: int):
    """The bucket of a row, as Spark's writer chooses it."""
    return F.pmod(F.hash(F.col(f"`{key}`")), F.lit(buckets))


def largest_bucket(df: DataFrame, key: str, buckets: int) -> tuple[int, float]:
    """Rows of the largest bucket, and of the average one; reads the key column alone."""
    sizes = df.groupBy(bucket_of(key, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    most, total = sizes.agg(F.max("rows"), F.sum("rows")).first()
    return most or 0, (total or 0) / buckets


def write_bucketed(
    df: DataFrame,
    path: str,
    key: str,
    buckets: int,
    sort: Sequence[str] = (),
    folders: str | None = None,
    most: float = MOST,
    small: int = SMALL_BUCKET,
) -> str:
    """Write ``df`` in ``buckets`` buckets of ``key``, sorted within each, in folders of a column if named.

    ``df`` is read twice, first its key alone; give a stored table if it is costly to compute.
    Rows are dealt to buckets by one shuffle, so each bucket (and folder) is one file.
    """
    largest, average = largest_bucket(df, key, buckets)
    if largest > max(most * average, small):
        raise UnevenBuckets(f"a bucket of {key} would hold {largest} rows, {average:.0f} on average")
    spark = df.sparkSession
    writer = df.repartition(buckets, F.col(f"`{key}`")).write.format("parquet").option("path", path)
    if folders:
        writer = writer.partitionBy(folders)
    name = f"claimscope_{uuid.uuid4().hex}"
    writer.bucketBy(buckets, key).sortBy(key, *sort).saveAsTable(name)
    # The files stay; the table is named again, by its path, by each session that reads it.
    spark.sql(f"drop table {name}")
    text = json.dumps(asdict(Layout(key, buckets, tuple(sort), folders)))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/{LAYOUT}")
    return path


def is_bucketed(spark: SparkSession, path: str) -> bool:
    """Whether :func:`write_bucketed` wrote the table."""
    context = spark.sparkContext
    layout = context._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{LAYOUT}")
    return layout.getFileSystem(context._jsc.hadoopConfiguration()).exists(layout)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table written by :func:`write_bucketed`, its buckets known to the planner."""
    text = spark.read.text(f"{path.rstrip('/')}/{LAYOUT}").first()["value"]
    layout = Layout(**json.loads(text))
    name = f"claimscope_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    if not spark.catalog.tableExists(name):
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        parts = f"partitioned by (`{layout.folders}`)" if layout.folders else ""
        order = ", ".join(f"`{c}`" for c in (layout.key, *layout.sort))
        spark.sql(
            f"create table {name} ({columns}) using parquet {parts} "
            f"clustered by (`{layout.key}`) sorted by ({order}) into {layout.buckets} buckets location '{path}'"
        )
        if layout.folders:
            spark.catalog.recoverPartitions(name)
    return spark.table(name)
