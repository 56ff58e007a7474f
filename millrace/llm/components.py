"""Connected components by smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link, given links (a, b) of long numbers.

    Each round gives a node the smallest label among its neighbours' and then that label's own label.
    Labels only fall, and jumps halve the way to the smallest node. Every round is written to the shared
    folder, so neither lineage nor lost executors reach back further. Links of a hub are joined by the
    hub's key in a plain join, which adaptive execution splits, and reduced by a partial aggregate.
    """
    links = stored(links.select("a", "b").where("a != b"), "links")
    both = links.union(links.select("b", "a"))
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a")
                .agg(F.min("component").alias("least")))
        lowered = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = stored(lowered.join(jump, "component", "left").select(
            "node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        if moved.where("old != component").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")
