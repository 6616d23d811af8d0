"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import materialise, scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); the component is its smallest node.

    Each round maps a node to the smallest of itself and its neighbours and contracts the edges, which
    shrink until none joins two classes. Each round's tables are written, so lineage stays short. A hub
    costs one aggregate with map-side combination and joins that Spark may split.
    """
    with scratch(edges.sparkSession) as keep:
        left = materialise(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        steps: list[DataFrame] = []
        while True:
            both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to")), "step")
            steps.append(step)
            via_a = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            via_b = via_a.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x != y")
            left = materialise(via_b.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
            if left.isEmpty():
                break
        found = steps[0].select("node", F.col("to").alias("component"))
        for step in steps[1:]:
            found = found.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return keep(materialise(found, "components"))
