"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, saved


def connected_components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, component): the least node that is reachable, for each node that has an edge to another.

    Each round links a node's larger neighbours, then its smaller ones, with the least of its neighbours, until the
    edges are stars: no node has two ends above it, or is both an upper and a lower end.
    A node's least neighbour is aggregated before the shuffle, and edges meet it in an equi-join that adaptive
    execution splits, so a node with very many edges is no hot task. Rounds are written tables: a lost executor
    repeats one round at most. Without edges the result is empty.
    """
    now = edges.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).where("u <> v").distinct()
    now = saved(now, "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour v of u is linked with the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, before = saved(large, "large-star"), now
        # small star: each smaller neighbour, and u itself, are linked with the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
        now = saved(small.select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "small-star")
        discard(before)
        discard(large)
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
