"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node with an edge; component is its least node.

    Alternating large-star and small-star steps: each is one grouped minimum and one join,
    the edge count never grows, and the steps needed grow with the logarithm of the graph's size.
    Each step is a written table; no part of the graph reaches the driver. What a join gives is shuffled
    again, so adaptive execution may split a node with very many edges over tasks.
    """
    e = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    while True:
        # large star: each node's greater neighbours are tied to its least neighbour or itself
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node's lesser neighbours and itself are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = materialize(tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # done when every node hangs on one node that hangs on none
        if small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        e = small
