"""Connected components by alternating stars over an edge table.

Each round joins the edges with every node's smallest neighbour (an aggregate
with partial sums, so a hub costs one row a task) and writes the new edges to the
shared folder. No node, edge or component comes to the driver: only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _least(pairs: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours v, for (u, v) pairs."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest node near u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.join(_least(both), "u").where("v > u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = _least(down)
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(u, component): every node of an edge (u, v) except the smallest of its component, with that smallest.

    Equal ends and repeated edges do no harm; an empty edge table gives an empty one.
    """
    spark = edges.sparkSession
    now = stored(edges.select("u", "v").where("u <> v").distinct())
    for _ in range(rounds):
        after = stored(small_star(large_star(now)))
        # a star forest: no node has two roots and no root hangs below another
        tangled = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").union(after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")).limit(1).count()
        drop_stored(spark, now)
        now = after
        if not tangled:
            break
    else:
        raise RuntimeError("components: not settled")
    return now.select("u", F.col("v").alias("component"))
