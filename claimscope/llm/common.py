"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import claimscope
from claimscope.session import scratch_path

# What separates words, as a regular expression of either engine.
GAPS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

ROW = "_row"
BATCH_ROWS = 512


def shared_table(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The rows of ``df``, written once below ``spark.checkpoint.dir`` and read back.

    Later steps then neither repeat the work nor depend on executors that may be lost.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_table(table: DataFrame) -> None:
    """Delete what :func:`shared_table` stored, once nothing reads it any more."""
    folders = {os.path.dirname(name) for name in table.inputFiles()}
    context = table.sparkSession.sparkContext
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give this package's source to the executors, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_claimscope_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(claimscope.__file__))
    archive = os.path.join(tempfile.mkdtemp(), "claimscope.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._claimscope_shipped = True


def map_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over batches of few rows, so that very long texts fit a worker.

    Lowers the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` where it is higher.
    """
    ship_package(df.sparkSession)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(step, schema)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in batches of about ``size`` bytes; none is empty."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


# Names of glibc's allocation settings, and the most that the second takes.
TRIM_THRESHOLD, MMAP_THRESHOLD, MMAP_MOST = -1, -3, 1 << 25


@lru_cache(maxsize=1)
def keep_freed_memory() -> None:
    """Let this worker keep the memory it frees for its next arrays.

    glibc returns large blocks to the system at once, and fetching them anew, page by page,
    took about two fifths of the time of steps that make many short-lived arrays. Peaks stay the
    same. Does nothing where there is no glibc.
    """
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(MMAP_THRESHOLD, MMAP_MOST)
        libc.mallopt(TRIM_THRESHOLD, 1 << 30)
    except (OSError, AttributeError):
        return


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def upto(count: Column) -> Column:
    """0, 1, ... count - 1; nothing where the count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def word_list(text: Column) -> Column:
    """Words of a text in order; a NULL text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda word: word != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def id_residue(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def with_row(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` packed into one struct column beside the named ones: names cannot clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(ROW), *(v.alias(k) for k, v in columns.items()))


def kept_columns(names: Sequence[str], taken: Sequence[str]) -> list[Column]:
    """Fields of the packed row by name; one whose name a result column bears becomes ``row_<name>``."""
    return [F.col(ROW)[n].alias(f"row_{n}" if n in taken else n) for n in names]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
