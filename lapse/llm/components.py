"""Connected components of a distributed edge list by alternating star contraction.

Large-star links every larger neighbour of a node to the node's least neighbour,
small-star every smaller one; a logarithmic number of rounds leaves one star per
component.  Minima are partial aggregates, so a hub costs one row per task, and the
join back to the edges is one that Spark can split.  Every round is written to the
shared folder; no edge or label reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import drop_dir, work_dir, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with u > v."""
    least = _least(edges)
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node has one larger end at most, and none is both an upper and a lower end."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return ends.where("ups > 1 or (ups = 1 and low = 0)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60, rows_per_task: int = 200_000) -> DataFrame:
    """(node, root) for every node of an edge (u, v); root is the least node it reaches.

    The number of tasks of a round follows the number of edges that are left."""
    spark = edges.sparkSession
    folder = work_dir(spark, "components")
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(),
                  f"{folder}/0")
    for i in range(1, most_rounds + 1):
        tasks = max(8, -(-now.count() // rows_per_task))
        if _is_star_forest(now.coalesce(tasks)):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        stars = _small_star(_large_star(now.coalesce(tasks)).coalesce(tasks)).coalesce(tasks)
        now = written(stars, f"{folder}/{i}")
        drop_dir(spark, f"{folder}/{i - 1}")
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
