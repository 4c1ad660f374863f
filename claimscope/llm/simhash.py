"""Near duplicates by 64-bit SimHash fingerprints and BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import ROW, map_arrow, shared_table, with_row
from claimscope.llm.components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
TREE_NODES = 32_768
CHUNK_ROWS = 65_536
FRONTIER = 300_000


def simhash(text: bytes, width: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of all word shingles; A-Z count as lower case."""
    import xxhash

    words = text.lower().split()  # of bytes: blanks are exactly 0x20 and 0x09-0x0D, letters exactly A-Z
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    runs = zip(*(words[k:] for k in range(width)), strict=False)
    hashes = np.fromiter((digest(b" ".join(run), SEED) for run in runs), dtype="<u8", count=len(words) - width + 1)
    sums = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = hashes[k : k + (1 << 16)]
        sums += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE, keep_row: bool = False, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp, a 64-bit fingerprint as signed long; with ``keep_row`` _row before them.

    NULL and empty texts have fingerprint zero.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    key = F.col(f"`{doc_id}`")
    if keep_row:
        slim = with_row(docs, doc_id=key, body=body)
    else:
        slim = docs.select(key.alias("doc_id"), body.alias("body"))
    fields = [f for f in slim.schema if f.name != "body"]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(x, width) for x in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64)
            columns = batch.columns[:-1] + [pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "fp"])

    return map_arrow(slim, prints, T.StructType([*fields, T.StructField("fp", T.LongType())]))


class BkForest:
    """One BK-tree per group of fingerprints, built and searched a level at a time.

    A node's children hang on it by their Hamming distance to it, one child per distance.
    ``group`` numbers the trees and is sorted; the first fingerprint of a group is its root.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps = fps
        opens = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
        self.roots = np.flatnonzero(opens)
        self.root_groups = group[self.roots]
        waiting = np.flatnonzero(~opens)
        parent = self.roots[np.searchsorted(self.root_groups, group[waiting])]
        edges, children = [], []
        while len(waiting):
            distance = np.bitwise_count(fps[waiting] ^ fps[parent]).astype(np.int64)
            edge = parent * 65 + distance
            distinct, first, place = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(distinct)
            children.append(waiting[first])
            parent = waiting[first][place]
            left = np.ones(len(waiting), bool)
            left[first] = False
            waiting, parent = waiting[left], parent[left]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(edge, kind="stable")
        self.edge, self.child = edge[order], child[order]

    def within(self, queries: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs at most ``radius`` bits apart, in the query's own tree.

        Follows only the edges whose distance differs from the query's by at most the radius.
        """
        at = np.searchsorted(self.root_groups, group)
        at = np.minimum(at, max(len(self.roots) - 1, 0))
        has = self.root_groups[at] == group if len(self.roots) else np.zeros(len(group), bool)
        stack = [(np.flatnonzero(has), self.roots[at[has]] if len(self.roots) else at[has])]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            distance = np.bitwise_count(queries[query] ^ self.fps[node]).astype(np.int64)
            hit = distance <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(distance - radius, 0), side="left")
            high = np.searchsorted(self.edge, node * 65 + np.minimum(distance + radius, 64), side="right")
            count = high - low
            total = int(count.sum())
            if total:
                ends = np.cumsum(count)
                step = np.arange(total) - np.repeat(ends - count, count)
                stack.append((np.repeat(query, count), self.child[np.repeat(low, count) + step]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; ``label`` holds each member's least member."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _spanning(tree: np.ndarray, tree_group: np.ndarray, query: np.ndarray, query_group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within the radius: one per fingerprint at most, not all pairs.

    Looks up tree members in their own tree and the further ``query`` rows in it too.
    """
    forest = BkForest(tree, tree_group)
    everyone = np.concatenate([tree, query])
    label = np.arange(len(everyone))
    groups = np.concatenate([tree_group, query_group])
    for a, b in forest.within(everyone, groups, radius):
        _merge(label, a, b)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return everyone[moved], everyone[label[moved]]


def links(prints: DataFrame, fp: str = "fp", radius: int = RADIUS, bands: int = RADIUS + 1, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(a, b): links between distinct fingerprints at most ``radius`` bits apart.

    The links are enough to join what belongs together; pairs that other links already join
    are left out. Two fingerprints within the radius agree in one of radius + 1 bands of
    bits, so each band value is a shard with a BK-tree of its own, and a fingerprint is
    looked up in the trees of its own band values only. A shard of more than ``tree_nodes``
    is split over several trees, each of which gets all the shard's fingerprints as look-ups,
    streamed: no task holds more than a tree and a chunk of look-ups, and no link is lost.
    Trees travel to their look-ups by the shuffle, as the trees of all shards grow with the
    corpus and so are no broadcast of proven size.
    """
    if bands <= radius:
        raise ValueError("fewer bands than radius + 1 would lose links")
    cuts = [64 * k // bands for k in range(bands + 1)]
    parts = [
        F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))
    ]
    banded = prints.select(F.col(fp).alias("fp"), F.explode(F.array(*parts)).alias("s")).select("fp", "s.*")
    sizes = banded.groupBy("band", "value").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > tree_nodes).select(F.col("band").alias("b"), F.col("value").alias("v"), F.ceil(F.col("n") / tree_nodes).cast("int").alias("trees"))
    known = banded.join(large, (F.col("band") == F.col("b")) & (F.col("value") == F.col("v")), "left")
    trees = F.coalesce("trees", F.lit(1))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), trees).cast("int")
    roles = F.transform(F.sequence(F.lit(0), trees - 1), lambda t: F.struct(t.alias("tree"), (t != own).alias("asks")))
    dealt = known.select("fp", "band", "value", F.explode(roles).alias("r")).select("band", "value", "r.tree", "r.asks", "fp")
    sorted_ = dealt.repartition("band", "value", "tree").sortWithinPartitions("band", "value", "tree", "asks", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(shard, asks, fps):
            number = np.cumsum(np.r_[0, (shard[1:] != shard[:-1]).any(axis=1)]) if len(shard) else np.zeros(0, np.int64)
            a, b = _spanning(fps[~asks], number[~asks], fps[asks], number[asks], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def joined(parts):
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            shard = np.stack([c.astype(np.int64) for c in columns[:3]], axis=1)
            waiting.append((shard, columns[3].astype(bool), columns[4].view(np.uint64)))
            size += len(shard)
            if size < CHUNK_ROWS:
                continue
            # Shards that ended are answered. Of an open one with many look-ups the tree stays.
            shard, asks, fps = joined(waiting)
            open_ = (shard == shard[-1]).all(axis=1)
            if not open_.all():
                yield answer(shard[~open_], asks[~open_], fps[~open_])
                shard, asks, fps = shard[open_], asks[open_], fps[open_]
            if int(asks.sum()) >= CHUNK_ROWS // 2:
                yield answer(shard, asks, fps)
                shard, asks, fps = shard[~asks], asks[~asks], fps[~asks]
            waiting = [(shard, asks, fps)]
            size = len(shard)
        if waiting:
            yield answer(*joined(waiting))

    return map_arrow(sorted_, search, "a long, b long")


def _groups(prints: DataFrame, radius: int) -> DataFrame:
    """fp, root (its component's least fingerprint) and component_id, the least document id there."""
    reps = shared_table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    members = connected_components(links(reps, radius=radius), "a", "b")
    named = members.select(F.col("node").alias("fp"), "component").join(reps, "fp")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    linked = named.join(least, "component").select(F.col("fp").alias("linked"), "component", "least")
    joined = reps.join(linked, reps["fp"] == linked["linked"], "left")
    root = F.coalesce("component", "fp").alias("root")
    return shared_table(joined.select("fp", root, F.coalesce("least", "rep").alias("component_id")), "groups")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row.

    Documents are linked at ``radius`` or fewer differing bits, and component_id is the
    least id reachable over links. NULL, empty and wordless texts have fingerprint zero and
    link like any other. Rows with equal ids count as documents of their own; NULL ids are
    no least id unless there is no other. An empty table gives an empty result.
    """
    prints = shared_table(with_fingerprints(docs, text, width, doc_id=doc_id), "simhash")
    groups = _groups(prints, radius).withColumnRenamed("fp", "known")
    joined = prints.join(groups, prints["fp"] == groups["known"])
    return joined.select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all columns: that of the least id, NULL ids last.

    Of several rows with that id one stays.
    """
    marked = with_fingerprints(docs, text, width, keep_row=True, doc_id=doc_id)
    rows = shared_table(marked.withColumn("rid", F.monotonically_increasing_id()), "simhash")
    groups = _groups(rows.select("doc_id", "fp"), radius).withColumnRenamed("fp", "known")
    slim = rows.select("doc_id", "fp", "rid")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    placed = slim.join(groups, slim["fp"] == groups["known"]).select("root", order.alias("o"))
    best = placed.groupBy("root").agg(F.min("o").alias("best")).select(F.col("best.rid").alias("kept"))
    kept = rows.join(best, rows["rid"] == best["kept"], "left_semi")
    return kept.select(f"{ROW}.*")
