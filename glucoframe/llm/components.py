"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.common import BROADCAST_ROWS
from glucoframe.session import cut_lineage


# A node with more edges than this, and than one in HEAVY_SHARE of all, meets its edges by broadcast; there are fewer than HEAVY_SHARE.
HEAVY, HEAVY_SHARE = 1_000, 100_000


def _with_least(edges: DataFrame, broadcast_rows: int) -> DataFrame:
    """Edges with the least neighbour of their u. The edges of one node are never brought into one task: the minimum is combined
    before its shuffle, and nodes with very many edges are broadcast unless all nodes can be."""
    found = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n")))
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return edges.join(F.broadcast(found.drop("n")), "u")
    total = found.agg(F.sum("n")).first()[0]
    heavy = F.col("n") > max(HEAVY, total // HEAVY_SHARE)
    marked = edges.join(F.broadcast(found.where(heavy).select("u", F.col("least").alias("known"))), "u", "left")
    light = marked.where("known IS NULL").drop("known").join(found.where(~heavy).drop("n"), "u")
    return light.unionByName(marked.where("known IS NOT NULL").withColumnRenamed("known", "least"))


def _large(edges: DataFrame, broadcast_rows: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    tied = _with_least(both, broadcast_rows).where(F.col("v") > F.col("u"))
    return tied.select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()


def _small(edges: DataFrame, broadcast_rows: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them. Edges run from larger to smaller."""
    tied = _with_least(edges, broadcast_rows)
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))
    return tied.select(F.inline(ends)).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def roots(edges: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) for every node with an edge; the root is the least node of its component.

    Takes columns u and v of longs, any direction; loops and repeated edges are allowed. The number of rounds is about
    the logarithm of the longest path. Each round is written to the shared folder, so a lost executor costs at most
    one round. Neighbours meet as a minimum per node (combined before the shuffle); nodes with very many edges are broadcast.
    """
    ordered = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut_lineage(ordered.distinct())
    before, state = None, _state(now)
    while state != before and state[0]:
        now = cut_lineage(_small(cut_lineage(_large(now, broadcast_rows)), broadcast_rows))
        before, state = state, _state(now)
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
