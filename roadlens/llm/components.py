"""Connected components of a table of links, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.storage import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``links`` (``a``, ``b``); a component is named
    by its smallest node. Each round takes the smallest label among the neighbours and then the
    label of that label, until nothing changes."""
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                   "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("component")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("other"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("near"))
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        step = step.join(up, "component").select("node", "old", F.least("component", "higher").alias("component"))
        step = written(step, "labels")
        changed = step.filter(F.col("old") != F.col("component")).limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
