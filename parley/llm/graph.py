"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """A written table (node, label, …): for each node of ``edges`` (a long, b long) the smallest node that it reaches.

    Smallest labels spread along edges and labels jump to their own labels, so a path of n nodes takes about log n
    rounds. Each round is written to the shared folder; only one count per round comes to the driver.
    """
    # written once: edges of a Python stage may be others when computed again, and each must count in both directions
    found = cut(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-found")
    both = cut(found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), name)
    release(found)
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        told = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = told.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label"))
        moved = cut(moved, name)
        release(labels)
        if moved.filter("old <> label").isEmpty():
            release(both)
            return moved
        labels = moved
