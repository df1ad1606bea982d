"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardframe.llm.common import materialise


def connected_components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """For every vertex of ``links`` (columns ``a``, ``b``): (``v``, ``root``), the
    least vertex that it reaches.

    Each round takes the least label among the neighbours and then the label of
    that label, so paths halve; a round's labels are written to the shared
    folder. Nothing but one count a round reaches the driver. With ``rounds`` it
    stops early: a root is then a smaller vertex of the same component, if not the least.
    """
    both = materialise(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
    labels, done = materialise(labels, "labels"), 0
    while True:
        if done == rounds:
            return labels
        done += 1
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        step = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("far"))
        moved = step.join(jump, "root", "left").select("v", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        moved = materialise(moved, "moved")
        labels = moved.select("v", "root")
        if rounds is None and not moved.where("root <> old").limit(1).count():
            return labels
