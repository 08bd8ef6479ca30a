"""Connected components of a graph that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relfold.llm.common import written


def components(edges: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """The smallest node of each node's component, as (node, root), for all nodes of ``edges``.

    Every round gives a node the least root among its neighbours and then that root's own root, until none
    changes; each round is a written table. Nodes with any number of edges are pre-aggregated.
    """
    pairs = edges.select(F.col(one).alias("a"), F.col(other).alias("b")).where("a is not null and b is not null")
    both = written(pairs.union(pairs.select("b", "a")).where("a <> b").distinct())
    roots = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
    while True:
        near = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        better = roots.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "least").alias("root"))
        up = roots.select(F.col("node").alias("at"), F.col("root").alias("above"))
        moved = written(better.join(up, F.col("root") == F.col("at")).select("node", "was", F.least("root", "above").alias("root")))
        roots = moved.select("node", "root")
        if not moved.where("was <> root").take(1):
            return roots
