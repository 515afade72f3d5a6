"""Connected components by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each id that has a link.

    edges: columns src, dst (long); direction, repeats, loops and nulls don't matter.
    Each round takes the smallest label of the neighbours and then the label of that label, so
    chains shorten fast. Labels are aggregated before they are dealt out, and a node with very
    many links only meets a join, whose large partitions Spark can split. Every round is a
    checkpoint in the shared folder. Returns id, component_id.
    """
    pair = edges.filter("src is not null and dst is not null and src != dst").select("src", "dst")
    both = cut(pair.union(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("label"))
    labels = cut(labels)
    while True:  # labels only fall, so the rounds end
        near = (
            both.join(labels.select(F.col("id").alias("dst"), "label"), "dst")
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        new = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = new.select(F.col("id").alias("label"), F.col("label").alias("up"))
        labels = cut(new.join(up, "label").select("id", "was", F.col("up").alias("label")))
        if labels.filter("was != label").isEmpty():
            return labels.select("id", F.col("label").alias("component_id"))
        labels = labels.drop("was")
