"""Token ids in binary files: blocks of ids as byte or bit planes, each compressed by zstandard.

Layout of a file, all numbers little-endian:

====================  ==========================================================
header                magic ``PLANES01``, plane kind (``B`` bytes, ``b`` bits), 7 zero bytes
planes                for each block in turn its 4 byte planes or 32 bit planes,
                      lowest first, each a zstandard frame
document index        a zstandard frame of 64-bit numbers: for each document its id, a flag
                      (1: the id is NULL), its first token in the file, its number of tokens
chunk index           64-bit numbers: for each block its number of ids, then the length
                      of each plane's frame
trailer               64-bit numbers: documents, blocks, length of the document index,
                      length of the chunk index; magic ``PLANES01``
====================  ==========================================================
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import map_arrow, shared_table
from claimscope.llm.tokens import END, encoder
from claimscope.session import scratch_path

MAGIC = b"PLANES01"
BLOCK = 1 << 16
LEVEL = 3
FILES_ROWS = 8000
UNIT_BYTES = 4096


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """A block of 32-bit ids as 4 byte planes or 32 bit planes, lowest first."""
    wide = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "B":
        return [np.ascontiguousarray(wide[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(wide, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    if kind == "B":
        wide = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        bits = [np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=count, bitorder="little") for p in planes]
        wide = np.packbits(np.stack(bits, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(wide).reshape(-1).view("<u4")


class Writer:
    """Appends documents to one file; holds one block and the document index."""

    def __init__(self, sink, kind: str = "B"):
        import zstandard

        self.sink, self.kind = sink, kind
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = 0
        self.docs: list[tuple[int, int, int, int]] = []
        self.chunks: list[list[int]] = []
        sink.write(MAGIC + kind.encode() + bytes(7))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, int(doc_id is None), self.tokens, len(ids)))
        self.tokens += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ready = np.concatenate(self.waiting)
            whole = len(ready) - len(ready) % BLOCK
            for k in range(0, whole, BLOCK):
                self._block(ready[k : k + BLOCK])
            self.waiting, self.held = [ready[whole:]], len(ready) - whole

    def _block(self, ids: np.ndarray) -> None:
        frames = [self.squeeze(p) for p in to_planes(ids, self.kind)]
        for frame in frames:
            self.sink.write(frame)
        self.chunks.append([len(ids), *map(len, frames)])

    def close(self) -> None:
        rest = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        if len(rest):
            self._block(rest)
        index = self.squeeze(np.array(self.docs, dtype="<i8").tobytes())
        chunks = np.array(self.chunks, dtype="<i8").tobytes()
        self.sink.write(index)
        self.sink.write(chunks)
        self.sink.write(np.array([len(self.docs), len(self.chunks), len(index), len(chunks)], dtype="<i8").tobytes() + MAGIC)


class Reader:
    """Documents of one file in order; holds the blocks a document lies in."""

    def __init__(self, source):
        import zstandard

        self.source = source
        self.open = zstandard.ZstdDecompressor().decompress
        size = source.size()
        source.seek(0)
        head = source.read(16)
        source.seek(size - 40)
        tail = source.read(40)
        if head[:8] != MAGIC or tail[32:] != MAGIC:
            raise ValueError("not a file of id planes")
        self.kind = head[8:9].decode()
        documents, blocks, index_size, chunk_size = np.frombuffer(tail[:32], dtype="<i8").tolist()
        source.seek(size - 40 - chunk_size - index_size)
        self.docs = np.frombuffer(self.open(source.read(index_size)), dtype="<i8").reshape(documents, 4)
        self.chunks = np.frombuffer(source.read(chunk_size), dtype="<i8").reshape(blocks, -1)

    def block(self, k: int) -> np.ndarray:
        """Ids of block ``k``, found through the chunk index alone."""
        sizes = self.chunks[k, 1:].tolist()
        self.source.seek(16 + int(self.chunks[:k, 1:].sum()))
        return from_planes([self.open(self.source.read(n)) for n in sizes], int(self.chunks[k, 0]), self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first token in the file, ids) of each document."""
        held, base, k = np.zeros(0, "<u4"), 0, 0
        for doc_id, missing, first, count in self.docs.tolist():
            held, base = held[first - base :], first
            parts = [held]
            have = len(held)
            while have < count:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield None if missing else doc_id, first, held[:count]


def _filesystem(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


def write(docs: DataFrame, tokenizer: str, folder: str, kind: str = "B", doc_id: str = "doc_id", text: str = "text", rows: int = FILES_ROWS, unit: int = UNIT_BYTES) -> DataFrame:
    """Ids of all documents, each with the end id, in files of ascending id; returns the manifest.

    Manifest: file (ascending in document order), path, n_docs, n_tokens. NULL ids come
    first; NULL texts count as empty. Texts are dealt out by ranges of the id (rows of one
    id by a hash of their text too), then each task encodes its range in order and writes a
    file. The file's name is new for each attempt and only committed attempts reach the
    manifest, so lost tasks leave files that nothing refers to. ``folder`` must be one all
    executors reach (file:, hdfs:, s3: or gs: address). Without documents there are no files.
    """
    key, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")
    more = F.coalesce(F.floor(F.octet_length(body) / unit), F.lit(0)).cast("int")
    # Rows without a text stand for the further units of a long one, so that ranges come out even in bytes.
    columns = docs.select(
        key.alias("doc_id"), body.alias("text"), F.coalesce(F.xxhash64(body), F.lit(0)).alias("tie"), F.explode(F.sequence(F.lit(0), more)).alias("unit")
    ).withColumn("text", F.when(F.col("unit") == 0, F.col("text")))
    order = [F.col("doc_id").asc_nulls_first(), "tie", "unit"]
    units = docs.agg(F.sum(more + F.lit(1).cast("long")).alias("n")).first()["n"] or 0
    files = max(1, min(-(-units // rows), 200_000))
    ranged = columns.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text", (F.col("unit") == 0).alias("whole"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, end = encoder(tokenizer), TaskContext.get().partitionId(), np.array([END], dtype="<u4")
        system, base = _filesystem(folder)
        path, sink, writer = "", None, None
        for batch in batches:
            batch = batch.filter(batch.column(2))
            for doc, ids in zip(batch.column(0).to_pylist(), tool.encode_all(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    system.create_dir(base, recursive=True)
                    path = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
                    sink = system.open_output_stream(f"{base}/{path}")
                    writer = Writer(sink, kind)
                writer.add(doc, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(writer.docs)], "n_tokens": [writer.tokens]})

    written = map_arrow(ranged, store, "file int, path string, n_docs long, n_tokens long")
    # One row per file, 200,000 at most: one task stores them all.
    return shared_table(written.repartition(1), "manifest")


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids (little-endian 32 bits)."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    # A file is one unit of work: one row, one task at most.
    dealt = files.repartition(max(1, min(manifest.count(), 20_000)), "path")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, home = _filesystem(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{home}/{path}") as source:
                    rows: list[tuple] = []
                    size = 0
                    for doc, first, ids in Reader(source).documents():
                        rows.append((doc, base + first, len(ids), ids.tobytes()))
                        size += len(ids)
                        if size > 1 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                    yield _rows(rows)

    return map_arrow(dealt, load, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "planes")
