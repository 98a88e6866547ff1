"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a partial aggregation (the least neighbour of each node, combined before the shuffle)
and a join, so a node with very many neighbours is never gathered, and nothing reaches the driver
but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Kept


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its least node.

    Edges with a null end, self-loops and repeated edges are ignored; without edges the result is
    empty.  The rounds needed grow with the logarithm of the longest path.
    """
    edges = edges.where(f"{a} != {b}").select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    now, before = Kept(edges.distinct(), "edges"), None
    while True:
        sign = now.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == before or not sign["n"]:
            break
        before = sign
        step = _small_star(_large_star(now.df).where("u != v").distinct()).where("u != v").distinct()
        then = Kept(step, "edges")
        now.drop()
        now = then
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.df.select("v", "v").distinct())
