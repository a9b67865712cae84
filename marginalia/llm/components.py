"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.session import Scratch, materialize


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root): the smallest node of each component, for every node that has an edge.

    A large star hangs the larger neighbours of each node on its least neighbour, a small star the smaller ones; the edge
    set then shrinks to stars within about log^2 of the longest path. Neighbourhoods are
    never gathered: a node's minimum is an aggregate, joined back, so a hub is a skewed join that adaptive execution
    splits. Every round is written to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "small")
        seen = None
        while True:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = both.filter("v > u").join(_minima(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = scratch.write(large, "large")
            scratch.drop("small")
            least = _minima(large)  # u > v in every row
            small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
            now = scratch.write(small, "small")
            scratch.drop("large")
            state = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) % 1000003 as bigint))")).first()
            if state == seen:
                return materialize(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                    now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
            seen = state
