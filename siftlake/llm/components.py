"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.session import checkpoint


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """One row (node, component) for each node of the undirected edges (a, b).

    `component` is the smallest node id that can be reached. Nodes are integers. Rows with a
    null end are ignored, self loops and repeated edges are allowed, an empty table gives an
    empty result. Minima are pre-aggregated before each shuffle and joined back, so that a hub
    node is one row of the small side and AQE can split its edges; no neighbour list is built.
    Each round is written to the shared checkpoint folder. Raises if `max_rounds` don't suffice
    (rounds grow with the logarithm of the longest path).
    """
    cur = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    cur = cur.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    nodes = cur.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    cur = checkpoint(cur.where("u <> v").distinct())
    for _ in range(max_rounds):
        # Done when the edges are stars: each larger end has one edge, and no smaller end is a larger one elsewhere.
        ends = cur.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e"))
        open_ends = ends.groupBy("e.n").agg(F.sum("e.out").alias("out"), F.max("e.into").alias("into"))
        if open_ends.where("out > 1 or (out = 1 and into = 1)").isEmpty():
            stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        # Large star: link each larger neighbour of a node to the least of node and neighbours.
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: link each smaller neighbour and the node itself to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        linked = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        cur = checkpoint(linked.select("e.u", "e.v").where("u <> v").distinct())
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
