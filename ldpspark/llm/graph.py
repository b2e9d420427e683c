"""Connected components of an edge list, by alternating star contraction.

Nodes may have any degree: minima are taken with partial aggregation, and the joins read settled inputs on
both sides, so that adaptive execution splits the partition of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldpspark.session import settle


def _lowest(edges: DataFrame) -> DataFrame:
    return settle(edges.groupBy("u").agg(F.min("v").alias("m")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` of any ordered type to ``(node, root)``: the smallest node reachable.

    Only nodes with an edge to another node come back. NULL ends and loops are ignored. Each round replaces the
    edges by at most as many; the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.where(F.col("u") != F.col("v"))
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = settle(edges.distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select("u", F.least("u", "m").alias("m"))
        far = both.join(low, "u").where(F.col("v") > F.col("u"))
        large = settle(far.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = _lowest(large)
        near = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
