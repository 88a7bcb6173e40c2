"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins, so a hub's edges are only ever a
join side that adaptive execution may split, never one task's group.  The edge
table of each round is written to the shared folder: nothing of it reaches the
driver except one row of counters that says whether the round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, in either direction, repeats and loops allowed.

    Returns ``(node, root)`` for every node that has an edge to another node, where
    root is the smallest node reachable.  No edges give no rows.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(ordered, "cc")
    mark = _mark(now)
    while True:
        after = materialize(_small_star(_large_star(now)), "cc")
        seen, mark = mark, _mark(after)
        release(now)
        now = after
        if seen == mark:
            break
    root = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return root.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Two order-free checksums and the count of a set of edges."""
    low = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(low), F.sum(F.shiftright(low, 20))).first())
