"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import materialize


def _to_least(edges: DataFrame, upward: bool) -> DataFrame:
    """Links what stands at a node to the least of its neighbours and itself.

    The least neighbour is an aggregate with partial sums, joined back, so a hub's rows never have to meet
    in one task. upward: only neighbours above the node move (large star); else edges point down (small star).
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a")
    if upward:
        return near.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs, in any direction: (node, root) for every node, root being the least node of its component.

    Each round is written to the shared folder; rounds end when one changes nothing. Loops and repeated
    edges do no harm; an empty table gives an empty one.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = materialize(_to_least(_to_least(both, True).distinct(), False).distinct(), "edges")
        if (after := state(now)) == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
