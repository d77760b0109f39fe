"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and two joins, cut off by a
written table, so that neither a chain of plans nor lost executors repeat earlier
rounds.  A node with very many neighbours is a skewed join key at worst, never one group
in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v): neighbours move to the smallest node around."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u long, v long) -> (node, component), the component named by its smallest node.

    Nodes without edges are not in the result; self-loops and repeated edges are harmless; an
    empty edge table gives an empty result.
    """
    edges = materialize(edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        edges = materialize(_stars(_stars(edges, True), False), "edges")
        seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (seen["n"], seen["x"]) == mark:
            break
        mark = (seen["n"], seen["x"])
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
