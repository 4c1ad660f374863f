"""Merkle manifest of a dataset: a tree per source, a tree over their roots, and proofs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import id_residue, shared_table
from claimscope.llm.ranks import ranked

ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STORED_EVERY = 4  # levels of proofs whose joins share one plan

PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` for NULL, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: Sequence[Column]) -> Column:
    return digest(*(field(v) for v in values))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof_hash(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``left`` and ``right``: hashes of a node's siblings before and after it, joined.

    The node with slot s of a run finds the one with slot s + d (mod arity) by an equijoin on
    the sibling's computed index, once for each d; in binary trees that index is an XOR.
    """
    slot = F.col("idx") % arity
    others = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("hash").alias("_hash"))
    found = nodes
    for d in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + d) % arity
        right = others.select(F.col("_tree").alias("_t"), F.col("_idx").alias("_i"), F.col("_hash").alias(f"_h{d}"))
        found = found.join(right, (F.col("tree") == F.col("_t")) & (sibling == F.col("_i")), "left").drop("_t", "_i")
    hashes = {d: F.col(f"_h{d}") for d in range(1, arity)}
    # In the order of d come first the slots after the node's own, then those before it.
    found = found.withColumn("left", F.concat_ws("", *(F.when(slot + d >= arity, h) for d, h in hashes.items())))
    found = found.withColumn("right", F.concat_ws("", *(F.when(slot + d < arity, h) for d, h in hashes.items())))
    return found.drop(*(f"_h{d}" for d in hashes))


def _grow(nodes: DataFrame, arity: int, label: str) -> list[DataFrame]:
    """Stored levels of all trees, leaves first: tree, idx, n (nodes of the level), hash, left, right.

    Slot zero of each run emits the parent. A tree ends at the level on which it has one
    node, its root; the last level holds the roots of the tallest trees.
    """
    levels = [shared_table(_with_siblings(nodes, arity), f"{label}-0")]
    most = levels[0].agg(F.max("n").alias("n")).first()["n"] or 0
    while most > 1:
        runs = levels[-1].where((F.col("n") > 1) & (F.col("idx") % arity == 0))
        parents = runs.select(
            "tree",
            F.floor(F.col("idx") / arity).cast("long").alias("idx"),
            F.ceil(F.col("n") / arity).cast("long").alias("n"),
            digest("hash", "right").alias("hash"),
        )
        levels.append(shared_table(_with_siblings(parents, arity), f"{label}-{len(levels)}"))
        most = -(-most // arity)
    return levels


def _paths(levels: list[DataFrame], above: DataFrame, arity: int, label: str) -> DataFrame:
    """Leaves with ``path``, siblings of every level up to the top, and ``top``, from the roots down.

    ``above`` has one row per tree: its ``top`` and the ``path`` above its root. Only a
    tree's root meets it, so no tree's leaves are joined by tree alone.
    """
    over = above.select(F.col("tree").alias("_t"), "path", "top")
    found = None
    for k in range(len(levels) - 1, -1, -1):
        roots = levels[k].where("n = 1").join(over, F.col("tree") == F.col("_t")).drop("_t")
        if found is None:
            found = roots
        else:
            parents = found.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("path").alias("_path"), "top")
            at = (F.col("tree") == F.col("_t")) & (F.floor(F.col("idx") / arity).cast("long") == F.col("_i"))
            step = F.struct("left", "right")
            below = levels[k].where("n > 1").join(parents, at).drop("_t", "_i")
            below = below.withColumn("path", F.concat(F.array(step), F.col("_path"))).drop("_path")
            found = below.unionByName(roots)
        if k and k % STORED_EVERY == 0:
            found = shared_table(found, f"{label}-paths-{k}")
    return found.drop("left", "right", "n", "idx")


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the trees of all sources and of the tree over their roots."""

    trees: list[DataFrame]
    top: list[DataFrame]
    arity: int

    @property
    def root(self) -> str | None:
        """The root over everything; None without rows."""
        found = self.top[-1].where("n = 1").first()
        return found["hash"] if found else None

    def subroots(self) -> DataFrame:
        """tree and hash of every source's root, one row each; tree is ``=source``, empty for NULL."""
        return self.top[0].select(F.col("name").alias("tree"), "hash")

    def proofs(self) -> DataFrame:
        """Every leaf with its ``hash``, ``subroot``, ``path`` up to the root, and what it carries."""
        start = self.top[-1].where("n = 1").select("tree", F.array().cast(PATH).alias("path"), F.col("hash").alias("top"))
        above = _paths(self.top, start, self.arity, "manifest-top")
        above = shared_table(above.select(F.col("name").alias("tree"), "path", F.col("hash").alias("top")), "manifest-above")
        return _paths(self.trees, above, self.arity, "manifest").withColumnRenamed("top", "subroot")


def build(leaves: DataFrame, order: str, arity: int = ARITY) -> Manifest:
    """A manifest over rows with ``source``, ``hash`` and ``order``; their other columns go along.

    Per source, leaves ascend by ``order`` (NULL first), ties by hash; while more than one
    node remains, every ``arity`` consecutive ones (the last run may be shorter) become one.
    The roots of the sources, NULL first, then bytewise by name, make a tree likewise. Rows
    that are equal throughout are leaves of their own. Without rows there is no root.

    No source is gathered in one task: leaves are placed by ranges, and each level's nodes
    meet their siblings by equijoins on index, so a run is the largest group there is.
    """
    # A name that is never NULL and keeps the bytewise order, NULL first.
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = leaves.withColumn("tree", tree).drop("source")
    placed = ranked(rows, "tree", [F.col(order).asc_nulls_first(), F.col("hash")], "manifest")
    trees = _grow(placed, arity, "manifest")
    roots = None
    for level in trees:
        some = level.where("n = 1").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
        roots = some if roots is None else roots.unionByName(some)
    top = _grow(ranked(roots, "tree", [F.col("name")], "manifest-top"), arity, "manifest-top")
    return Manifest(trees, top, arity)


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row against its proof.

    A leaf is the hash of doc_id, source, lang, n_chars and text, NULL told from empty. Where
    the CRC-32 of the id is even the row is taken as tampered with, its text without line
    feeds, and the root is recomputed from that; a text without one still verifies. A NULL
    id counts as even. Without rows the result is empty.
    """
    values = {c: F.col(f"`{c}`") for c in COLUMNS}
    cut = F.when(id_residue(values["doc_id"], 2) == 0, F.translate(values["text"].cast("string"), "\n", "")).otherwise(values["text"])
    leaves = docs.select(
        values["doc_id"].alias("doc_id"),
        values["source"].alias("source"),
        leaf_hash(list(values.values())).alias("hash"),
        leaf_hash([*list(values.values())[:-1], cut]).alias("found"),
    )
    made = build(leaves, "doc_id")
    folded = fold(F.col("found"), F.col("path"))
    return made.proofs().select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        F.lit(made.root).cast("string").alias("root"),
        proof_hash(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.lit(made.root)).alias("verified"),
    )
