"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import checkpointed

#: Rounds after which the result would be wrong; the number needed grows with the logarithm of the input.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the vertex's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex itself, is linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).filter("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex with an edge; root is the least vertex of its component.

    ``edges`` has two columns u and v of one ordered type. Self-loops and
    repeated edges do no harm; without edges the result is empty. The minimum
    per vertex is pre-aggregated, and joins on a hub are left to Spark's skew
    handling, so no vertex's neighbours gather in one group.
    """
    now = checkpointed(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        now = checkpointed(_small_star(_large_star(now)))
        if (after := _state(now)) == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
