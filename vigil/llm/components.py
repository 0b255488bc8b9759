"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import written


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node with an edge; the component is its smallest node.

    Edges (a, b) of longs. Each round replaces a node's edges by edges to the smallest of its neighbours:
    first for the larger neighbours, then for the smaller ones. The number of rounds grows with the
    logarithm of the number of nodes. A node's neighbours are never brought together: their minimum is
    aggregated and joined back, so a node with very many edges is no trouble. Every round is written to
    the shared folder. Ends when a round changes nothing.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()
        # small star: smaller neighbours of u, and u, go to the smallest of them
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("a").alias("b"), F.col("m").alias("a")).where("a < b").unionByName(down.select("b", F.col("m").alias("a"))).distinct()
        now = written(small.select("a", "b"), "edges")
        n = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h"), F.countDistinct("b").alias("nodes")).first()
        if (n.n, n.h) == before and n.n == n.nodes:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = (n.n, n.h)
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")
