"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.runtime import cut

#: Edges from which hubs may be hot; below, a round is not worth two more writes.
LARGE = 5_000_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; the component is its smallest node.

    Each round links every node to the smallest node it knows (large star), then the knowledge is passed on (small star);
    the edges never become more and a hub keeps one edge per node. A hub's edges meet in one join key; in a large table the
    smallest nodes are written first, so that both sides of the join are plain shuffles, which adaptive execution splits.
    Rows with a null end are ignored; loops make components of one node; an empty table gives none.
    """
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    current = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, settled = None, cut if current.count() > LARGE else lambda df: df
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = settled(least)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settled(large)
        least = settled(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array_distinct(F.array("u", "v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        current = cut(small)
        mark = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.min("v")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
