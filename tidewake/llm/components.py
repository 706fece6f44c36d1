"""Connected components of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import checkpoint


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; a component's name is its smallest node.

    Each round hooks a node to the least name among its neighbours and then
    follows names to their own names, which halves long chains. Rounds go on
    until none changes a name; each is checkpointed, so lineage stays short and
    lost executors cost one round at most.
    """
    one = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = checkpoint(one.union(one.select("y", "x")).distinct())
    names = edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component"))
    names = checkpoint(names)
    while True:
        near = (
            edges.join(names.withColumnRenamed("node", "y"), "y")
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = names.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = names.select(F.col("node").alias("to"), F.col("component").alias("further"))
        moved = checkpoint(
            hooked.join(jump, "to", "left").select("node", "was", F.least("to", F.coalesce("further", "to")).alias("component"))
        )
        names = moved.select("node", "component")
        if moved.where(F.col("was") != F.col("component")).isEmpty():
            return names
