"""Records of quoted text files that may span lines, cut in parallel.

Spark's own reader takes one task per file once cells may hold line ends. Here a file is
read by lines in many splits. Whether a line begins inside a quoted cell depends only on
the number of quotes before it, odd or even. So the quotes of each split are counted, their
parities summed over the splits of a file, and each split then cuts its lines into records
by itself; only the pieces of records that cross splits meet again.

A quote may stand in quoted cells only, doubled there, as RFC 4180 has it. A stray quote
in a bare cell would turn inside and outside around for the rest of its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
PIECES = "text string, file string, split long, row long, head boolean, open boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and the split they were read in; carriage returns stay."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("text"), *at)


def _split_states(lines: DataFrame) -> DataFrame:
    """Per split: whether its first line begins inside a quoted cell, and whether its end does.

    One row per split, hence at most the bytes of the input over those of a split.
    """
    quotes = F.length("text") - F.length(F.replace("text", F.lit(QUOTE), F.lit("")))
    odd = lines.groupBy("file", "split").agg((F.sum(quotes.cast("long")) % 2).alias("odd"))
    upto = Window.partitionBy("file").orderBy("split")
    after = F.sum("odd").over(upto) % 2 == 1
    return odd.select(F.col("file").alias("f"), F.col("split").alias("s"), (after != (F.col("odd") == 1)).alias("inside"), after.alias("unended"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one or more splits, in order, as records and pieces of records."""
    here: tuple | None = None
    pending: list[str] = []  # lines of the record that is open
    row, head, inside = 0, False, False

    def rest() -> Iterator[pa.RecordBatch]:
        nonlocal pending
        if pending:
            yield pa.RecordBatch.from_arrays(
                [pa.array(["\n".join(pending)]), pa.array([here[0]]), pa.array([here[1]], pa.int64()), pa.array([row], pa.int64()), pa.array([head]), pa.array([True])],
                ["text", "file", "split", "row", "head", "open"],
            )
        pending = []

    for batch in batches:
        texts, files, splits, starts = (batch.column(k) for k in range(4))
        size = batch.num_rows
        moved = np.ones(size, dtype=bool)
        if size > 1:
            other = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(splits[1:], splits[:-1]))
            moved[1:] = other.to_numpy(zero_copy_only=False)
        firsts = np.flatnonzero(moved)
        for a, b in zip(firsts, np.append(firsts[1:], size), strict=True):
            at = (files[int(a)].as_py(), splits[int(a)].as_py())
            if at != here:
                yield from rest()
                here, row, head = at, 0, starts[int(a)].as_py()
                inside = head
            some = texts[int(a) : int(b)]
            quotes = pc.count_substring(some, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64)
            open_after = (np.cumsum(quotes) + inside) % 2 == 1
            inside = bool(open_after[-1])
            ends = np.flatnonzero(~open_after) + 1
            if not len(ends):
                pending += some.to_pylist()
                continue
            offsets = pa.array(np.append(0, ends), pa.int32())
            whole = pc.binary_join(pa.ListArray.from_arrays(offsets, some.slice(0, int(ends[-1]))), "\n")
            if pending:
                joined = "\n".join([*pending, whole[0].as_py()])
                whole = pa.concat_arrays([pa.array([joined], whole.type), whole[1:]])
            count = len(whole)
            heads = np.zeros(count, dtype=bool)
            heads[0] = head
            yield pa.RecordBatch.from_arrays(
                [whole, pa.array([at[0]] * count), pa.array(np.full(count, at[1])), pa.array(row + np.arange(count)), pa.array(heads), pa.array(np.zeros(count, dtype=bool))],
                ["text", "file", "split", "row", "head", "open"],
            )
            row, head = row + count, False
            pending = some.slice(int(ends[-1])).to_pylist()
    yield from rest()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """text, file, split, row: every record of the files, with the split and the place in it
    where it begins; records ascend by these within a file.

    Reads the text three times (quotes; records; the splits around a record that crosses
    two), shuffles nothing of it but such records, and starts no job by itself. A record
    that is never closed ends with its file.
    """
    lines = _lines(spark, path)
    states = _split_states(lines)
    # One row per split of the input, see there: a few hundred thousand for 100 TB.
    known = lines.join(F.broadcast(states), (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    columns = ["text", "file", "split", "inside"]
    whole = known.select(*columns).mapInArrow(_cut, PIECES).where("not head and not open")
    crossing = known.where("inside or unended").select(*columns).mapInArrow(_cut, PIECES).where("head or open")
    line = Window.partitionBy("file").orderBy("split", "row")
    numbered = crossing.withColumn("record", F.count_if(~F.col("head")).over(line))
    pieces = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("split", "row", "text"))).alias("p"))
    joined = pieces.select(F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), "file", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["row"].alias("row"))
    records = whole.select("text", "file", "split", "row").unionByName(joined)
    # What is left of a line end of two characters.
    ended = F.when(F.endswith("text", F.lit("\r")), F.left("text", F.length("text") - 1)).otherwise(F.col("text"))
    return records.withColumn("text", ended)
