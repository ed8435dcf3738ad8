"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """node, component (its smallest node) for links (a, b); nodes without links aren't there.

    Each round, every node takes the smallest label of itself and its neighbours, then the label of its label; rounds
    follow the logarithm of the longest path. Labels stay in the shared folder, two rounds' at most; the driver sees
    whether a label changed.
    """
    with Scratch(links.sparkSession) as own:
        given = own.keep(links.where("a <> b").select("a", "b").distinct())
        edges = own.keep(given.union(given.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        labels = own.keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
        while True:
            near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
            new = own.keep(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
            own.drop(labels)
            labels = new.select("node", "label")
            if not new.where("label <> old").limit(1).count():
                return stored(labels.select("node", F.col("label").alias("component")), folder)
