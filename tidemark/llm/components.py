"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b: long): label is the smallest node that it reaches.

    Every round points each node to its smallest neighbour or itself, follows
    the pointers once more, and contracts the links to the nodes pointed to;
    links shrink geometrically, and the loop ends when none is left.  Nothing
    but counts reaches the driver.  A hub's links are counted down by partial
    aggregation and spread by the join's skew handling.
    """
    at = stage.write(links.where("a <> b").select("a", "b").distinct())
    labels = None
    while not at.isEmpty():
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to")))
        # pointers go to ever smaller nodes, so following them twice is safe
        over = stage.write(up.join(up.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        if labels is None:
            following = over.select("node", F.col("to").alias("label"))
        else:
            following = labels.join(over.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        following = stage.write(following)
        left = at.join(over.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(over.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = stage.write(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        stage.drop(at, up, over, *([labels] if labels is not None else []))
        at, labels = left, following
    return labels if labels is not None else at.select(F.col("a").alias("node"), F.col("b").alias("label"))
