"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b): the least label spreads, by trees and pointer jumping.

    In every round, the least label next to any node of a tree goes to its root and all its nodes, so that trees that
    touch become one, whatever their size, and the number of rounds goes by the logarithm of theirs. Every round is
    cut by a checkpoint in the shared folder.
    """
    both = runtime.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = runtime.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(runtime.shuffled(roots.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(runtime.shuffled(seen), "node").select("node", F.col("root").alias("old"), "near")
        lower = step.select(F.col("old").alias("root"), F.col("near").alias("far")).unionByName(roots.select(F.col("node").alias("root"), F.col("root").alias("far")))
        lower = lower.groupBy("root").agg(F.min("far").alias("far"))
        new = runtime.cut(step.withColumn("root", F.col("old")).join(runtime.shuffled(lower), "root").select("node", "old", F.least("old", "near", "far").alias("root")))
        roots = new.select("node", "root")
        if new.where("old != root").isEmpty():
            return roots
