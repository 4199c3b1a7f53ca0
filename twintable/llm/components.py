"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twintable.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """Columns ``vertex`` and ``root``, the smallest vertex reachable, for each vertex of ``a`` and ``b``.

    Every vertex joins its smallest neighbour below it, then the edges are rewritten and
    repeated ones dropped, until none is left: the number of vertices that are not local
    minima falls in each round, so rounds follow the logarithm of the longest path. All
    steps are joins and minima; a hub costs one row per map task. Loops and nulls are
    dropped; an empty table gives an empty one.
    """
    left = keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    )
    labels = left.select(F.col("high").alias("vertex")).union(left.select("low")).distinct().withColumn("root", F.col("vertex"))
    while not left.isEmpty():
        step = keep(left.groupBy("high").agg(F.min("low").alias("to")))
        labels = keep(
            labels.join(step, labels["root"] == step["high"], "left").select("vertex", F.coalesce("to", "root").alias("root"))
        )
        ends = left.join(step, "high").select(F.col("to").alias("x"), "low")
        again = step.select(F.col("high").alias("low"), F.col("to").alias("low_to"))
        ends = ends.join(again, "low", "left").select("x", F.coalesce("low_to", "low").alias("y"))
        left = keep(ends.where("x <> y").select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct())
    return labels
