"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, written


def connected_components(links: DataFrame) -> DataFrame:
    """The least node of each linked node's component: node, label. links: a, b.

    Rounds of large-star and small-star: first every node sends its greater
    neighbours to the least it sees, then every node joins its lesser
    neighbours there. Links only move towards the least node, so rounds grow
    with the logarithm of a component's size. Each step is a written table,
    which a later one removes; neither nodes nor links come to the driver.

    A node's least neighbour comes from a sum that Spark makes before it
    shuffles. Only nodes between others, and nodes with several lesser
    neighbours, have anything to send; links are joined with the table of
    these, a plain join whose hot keys Spark can split, so that the centre of
    a star of very many nodes is no task's own.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "component-links", True)
    while True:
        roles = edges.select(F.col("u").alias("node"), F.col("v").alias("least"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).alias("least"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        busy = roles.groupBy("node").agg(F.min("least").alias("least"), F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        busy = written(busy, "component-nodes", True)
        if busy.isEmpty():
            removed(busy)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        between = busy.where("down = 1").select(F.col("node").alias("v"), "least")
        large = written(edges.join(between, "v", "left").select("u", F.coalesce("least", "v").alias("v")).distinct(), "component-links", True)
        several = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("u", "m"), "component-nodes", True)
        moved = large.join(several, "u", "left").withColumn("m", F.coalesce("m", "v"))
        small = moved.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, written(small.select("e.u", "e.v").where("u <> v").distinct(), "component-links", True)
        removed(before, busy, large, several)
