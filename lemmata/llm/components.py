"""Connected components by rounds of joins; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable.

    Each round hooks every node to the smallest label among its neighbours and
    then jumps to that label's own label, until nothing changes.  Rounds are
    stored, so a lost executor costs one round.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("component", "near").alias("hook"), "component")
        up = labels.select(F.col("node").alias("hook"), F.col("component").alias("jump"))
        after = stored(hooked.join(up, "hook").select("node", F.least("hook", "jump").alias("component"), (F.least("hook", "jump") != F.col("component")).alias("moved")), "labels")
        labels = after.select("node", "component")
        if not after.filter("moved").limit(1).count():
            return labels
