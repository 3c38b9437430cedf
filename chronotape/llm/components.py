"""Connected components of a table of links, by rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotape.plans.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the smallest node of its component.

    Each round takes the smallest label among the neighbours, then follows labels once (a label's own
    label), so paths halve; it ends when a round changes nothing. Every step is written, so a lost executor
    repeats one step at most. Empty links give an empty table.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        lowered = labels.unionByName(heard).groupBy("node").agg(F.min("label").alias("label"))
        lowered = written(lowered, "labels")
        further = lowered.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(lowered.join(further, "label").select("node", F.col("next").alias("label")), "labels")
        old = labels.select("node", F.col("label").alias("old"))
        if new.join(old, "node").where("label <> old").isEmpty():
            return new
        labels = new
