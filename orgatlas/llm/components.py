"""Connected components of a link table by alternating star operations, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgatlas.llm.shared import forget, materialize

#: Far more rounds than any graph needs: each at least halves the depth of the trees.
MOST_ROUNDS = 60


def _lowest(pairs: DataFrame) -> DataFrame:
    """For each u its least neighbour, or u itself; pre-aggregated before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    moved = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and itself, move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = _lowest(down)
    moved = down.join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b")).union(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not the least of its component."""
    edges = materialize(edges.where("a <> b").select("a", "b").distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        sign = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sign["n"] == 0 or sign == before:
            break
        before = sign
        older, edges = edges, materialize(_small_star(_large_star(edges)))
        forget(older)
    else:
        raise RuntimeError(f"components are not done after {MOST_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
