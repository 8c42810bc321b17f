"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node in ``links`` (a, b).

    Each round takes the smallest label around a node and then that label's own label, so that
    chains shrink by half or better. Rounds are written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one"), "links")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        .select("node", F.least("node", "near").alias("component")),
        "labels",
    )
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        nearer = labels.join(around, "node").select(
            "node", F.least("component", "near").alias("step"), F.col("component").alias("was")
        )
        further = labels.select(F.col("node").alias("step"), F.col("component").alias("beyond"))
        labels = written(
            nearer.join(further, "step", "left").select(
                "node", F.least("step", F.coalesce("beyond", F.col("step"))).alias("component"), "was"
            ),
            "labels",
        )
        if labels.filter("component <> was").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
