"""Connected components of an edge table, as joins with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``: root is the smallest node of the component.

    Every node takes the smallest label around it, then the label of its
    label, until nothing changes; each round is a table in the shared folder.
    Self-loops and repeated edges are harmless; an empty table gives an empty one.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(spark, both.distinct(), "cc-edges")
    labels = written(spark, both.groupBy(F.col("a").alias("node"))
                     .agg(F.least(F.col("a"), F.min("b")).alias("root")), "cc-labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low")))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        labels = written(spark, step.join(up, "root").select("node", "old", F.least("root", "up").alias("root")), "cc-labels")
        if not labels.where("old <> root").limit(1).count():
            return labels.select("node", "root")
