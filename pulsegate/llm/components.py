"""Connected components of a table of links, by smallest labels and label shortcuts."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegate.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node in ``links`` (a, b): the smallest node it reaches.

    Each round takes the smallest label of the neighbours, then the label of that label, so
    rounds grow with the logarithm of the longest path. Every round is a written table; only a
    count of changed labels reaches the driver. A hot node meets its neighbours in sums
    that combine before the shuffle.
    """
    both = staged(links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionAll(
        links.select(F.col("b").alias("node"), F.col("a").alias("next"))).distinct(), "edges")
    labels = staged(both.groupBy("node").agg(F.min("next").alias("low")).select(
        "node", F.least("node", "low").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("next"), F.col("label").alias("low")),
                         "next")
        best = seen.groupBy("node").agg(F.min("low").alias("low")).join(labels, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "low").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        fresh = staged(best.join(jump, "mid", "left").select(
            "node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        labels = fresh.select("node", "label")
        if fresh.filter("label <> old").isEmpty():
            return labels
