"""Connected components of a link table by alternating large-star and small-star steps.

Every step is an aggregate (the smallest neighbour, combined before the
shuffle) and a join back.  The aggregate is shuffled on its own, so both sides
of the join are plain shuffles and adaptive execution may split a node with
very many links.  After each round the edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import written


def _nearest(edges: DataFrame) -> DataFrame:
    """``u, m``: the smaller of each node and its smallest neighbour."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition("u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.filter("v > u").join(_nearest(both), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearest(down)
    moved = down.join(near, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(near.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (u, v)``; the root is the component's smallest node and its own root.

    Self links and empty tables give no rows.  Rounds go on until one changes nothing.
    """
    edges = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
