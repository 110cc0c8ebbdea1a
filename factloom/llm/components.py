"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b); a component is named by its smallest node.

    Each round takes the smallest name among the neighbours and then the name of
    that name, so long paths shorten by more than half; stars take two rounds.
    Every round is written to the shared checkpoint folder.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    names = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")))
    while True:
        near = both.join(names.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = names.join(near, "node").select("node", "component", F.least("component", "near").alias("name"))
        of_name = lower.select(F.col("node").alias("name"), F.col("name").alias("further"))
        stepped = durable(lower.join(of_name, "name").select("node", F.col("further").alias("component"), (F.col("further") < F.col("component")).alias("moved")))
        names = stepped.select("node", "component")
        if stepped.filter("moved").isEmpty():
            return names
