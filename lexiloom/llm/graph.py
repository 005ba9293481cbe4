"""Connected components of an edge table, without a driver-side graph.

Alternating large-star and small-star steps: every step replaces a node's
edges by edges to the smallest neighbour, so the edge count never grows and a
component of any shape ends as a star after a logarithmic number of rounds.
Neighbour minima come from a map-side-combined aggregate and are joined back,
so a node with very many neighbours is never gathered in one task; the join is
one that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_path, durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than u is hung on the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node; u and its smaller neighbours are hung on the least."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` pairs of longs, in any order -> ``(node, component)`` of every node with an edge.

    ``component`` is the smallest node reachable.  Null ends and loops are
    ignored; repeated edges count once; no edges give no rows.  Raises if the
    graph has not settled after ``max_rounds`` (2^60 nodes would have).
    """
    seed = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")
    )
    state, path = durable(seed.distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        mark = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == before or mark[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select("v", "v").distinct())
        before = mark
        step, new = durable(_small_star(_large_star(state)), "edges", 2 * mark[0])
        drop_path(state.sparkSession, path)
        state, path = step, new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
