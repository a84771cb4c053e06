"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); a component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, then the label
    of that label, which halves the distance to the smallest node. Sums and joins are by
    node, with partial aggregation; each round's labels are written to the shared folder.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = edges.join(labels.hint("merge"), edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near.hint("merge"), labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("low"))
        lower = stored(lower, "lower")
        target = lower.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        after = stored(lower.join(target.hint("merge"), "low").select("node", "component", F.least("low", "jump").alias("next")), "labels")
        labels = after.select("node", F.col("next").alias("component"))
        if after.filter("component <> next").isEmpty():
            return labels
