"""Connected components of an undirected graph, as joins over its edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import shared_table


def _spread(node: Column) -> Column:
    """A second join key that follows from the first.

    With it the join's input differs from the aggregation's output, so Spark deals out both
    sides anew and adaptive execution may split a node with very many edges.
    """
    return F.xxhash64(node)


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least node among u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, (edges["u"] == least["w"]) & (_spread(edges["u"]) == _spread(least["w"]))).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node u to the smaller v."""
    joined = _with_least(edges)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v")


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Equal marks: equal edge sets, but for a chance of 2 ** -64."""
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component``, the least node of its component, for nodes with an edge.

    Alternates large-star and small-star steps, which shrink every component to a star
    around its least node in a number of rounds that grows with the logarithm of its size.
    Each round's edges go to the shared folder. Edges with a NULL end and loops are left
    out; repeated edges count once; without edges the result is empty.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    now = shared_table(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        after = shared_table(_small_star(_large_star(now)).distinct(), "edges")
        fresh = _mark(after)
        now = after
        if fresh == mark:
            break
        mark = fresh
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
