"""Connected components over links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the smallest node around it."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Stored, so that both sides of the join are plain shuffles and the edges of a hub may be split among tasks.
    low = cut(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")))
    linked = near.join(low, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """`(node, root)` of every node in `links(u, v)`: the smallest node of its component.

    A node learns its smallest neighbour by a partial aggregation.  A hub's edges meet that one row in a join of two
    shuffles, which adaptive execution splits where a hub has too many.  Each step is cut into the shared folder;
    rounds grow with the logarithm of the longest chain.
    """
    edges = cut(links.where("u <> v").select("u", "v").distinct())
    state = None
    while True:
        edges = cut(_step(_step(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components `(node, root)` after more `links(u, v)`: only the roots that these touch are solved again."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    lifted = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
    between = components(lifted.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")))
    moved = between.select(F.col("node").alias("root"), F.col("root").alias("top"))
    # A root that the links touch moves with its nodes; it is not among the nodes of `roots` itself.
    below = roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(below.union(between))
