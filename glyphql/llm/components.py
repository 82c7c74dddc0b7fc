"""Connected components of a graph given as a table of edges, by alternating star contractions.

Each round every node learns the smallest node among its neighbours by an aggregate and a join; trees flatten to stars
in O(log^2 n) rounds. Edges stay in the cluster, and each round's edges are a written table, so that lost executors cost
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.count_if(F.col("u") <= F.col("v"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` of every node that has an edge; component: the smallest node that it reaches.

    Loops and repeated edges are ignored; a table without edges gives an empty result."""
    pairs = edges.where(F.col(a) != F.col(b))
    now = materialise(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = materialise(_small_star(_large_star(now)), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    root = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(root)
