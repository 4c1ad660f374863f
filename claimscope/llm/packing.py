"""Packing documents into token sequences: concatenate and cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import gathered, map_arrow, shared_table
from claimscope.llm.tokens import END, LOT_CHARS, encoder

LENGTH = 1024


def token_table(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, at, doc_id, n_tokens, ids: each document's ids with the end id, stored once.

    ``part`` is the task that wrote the row and ``at`` the tokens before it in that task.
    Both come from the attempt whose file was committed, so they agree whatever is retried.
    """
    columns = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        small = tool.tool.get_vocab_size() <= 1 << 16
        for batch in gathered(batches, LOT_CHARS):
            packed, counts = [], []
            for ids in tool.encode_all(batch.column(1).to_pylist()):
                ids = np.append(ids, np.uint32(END))
                packed.append(ids.astype("<u2" if small else "<u4").tobytes())
                counts.append(len(ids))
            n = np.array(counts, dtype=np.int64)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(before), batch.column(0), pa.array(n), pa.array(packed, pa.binary())],
                ["part", "at", "doc_id", "n_tokens", "ids"],
            )

    return shared_table(map_arrow(columns, encode, "part int, at long, doc_id long, n_tokens long, ids binary"), "tokens")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Adds ``first``: the tokens before each document in the whole corpus.

    First pass: totals per part. Their running sum, over one row per part, is the offset of
    each part. Second pass: the offset of the part and the place within it make the sum.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Stored, so that Spark knows its size and need not deal out the tokens to join it.
    bases = shared_table(totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    joined = tokens.join(bases, F.col("part") == F.col("p"))
    return joined.select("doc_id", "n_tokens", "ids", (F.col("base") + F.col("at")).alias("first"))


def cut(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens, from rows of :func:`with_offsets`.

    A document lies in every window that its tokens touch, one piece (boundary record) each:
    doc_id, start, length, ids (little-endian 32 bits), doc_tokens, sequence_id, offset.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, n, raw, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                edges = np.arange(first // length, (first + n - 1) // length + 1) * length
                starts = np.maximum(edges, first)
                ends = np.minimum(edges + length, first + n)
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    rows.append((doc, s - first, e - s, ids[s - first : e - first].tobytes(), n, s // length, s % length))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return map_arrow(tokens.select("doc_id", "n_tokens", "ids", "first"), pieces, schema)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents, each followed by the end id, laid end to end and cut every ``length`` tokens.

    Only the last sequence needs padding. NULL texts count as empty: their end id alone.
    Repeated rows are packed as often as they occur; no rows give no pieces. The order is
    that of the input's partitions.
    """
    return cut(with_offsets(token_table(docs, tokenizer, doc_id, text)), length)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, ids (little-endian 32 bits, ``length`` ids) and n_tokens before padding.

    A sequence gathers at most ``length`` pieces.
    """
    some = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), some.alias("some"))
    filler = F.repeat(F.lit(pad.to_bytes(4, "little").hex()), (F.lit(length) - F.col("n_tokens")).cast("int"))
    return joined.select("sequence_id", F.unhex(F.concat(F.array_join(F.transform("some", lambda x: F.hex(x["ids"])), ""), filler)).alias("ids"), "n_tokens")
