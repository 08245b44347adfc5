"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of links (a, b) and the least node it reaches.

    Each round takes the least label among a node and its neighbours, then follows labels once; it stops when no label
    changes. Labels stay in tables: only a count comes to the driver. Loops, repeated links and an empty table are fine.
    """
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    for _ in range(most_rounds):
        told = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        nearer = labels.join(told, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = cut(nearer.join(jump, "component", "left").select("node", "old", F.coalesce(F.least("component", "further"), "component").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("old <> component").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"links have not settled after {most_rounds} rounds")
