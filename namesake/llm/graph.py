"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each end of the links (a, b) reaches. Nodes without a link are left out.

    Each round maps a node to the smallest of its neighbours and itself, and puts the mapped nodes in the links' place;
    links within a node go. The rounds are as many as the logarithm of the longest way, and each one's tables are
    written, so that lost executors cost one round.
    """
    links = materialize(edges.select("a", "b").filter("a <> b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label")
    labels = materialize(labels)
    step = labels
    while True:
        first = step.select(F.col("node").alias("a"), F.col("label").alias("x"))
        second = step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        moved = links.join(first, "a").join(second, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = materialize(moved)
        if links.isEmpty():
            return labels
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label")
        step = materialize(step)
        renamed = step.select(F.col("node").alias("old"), F.col("label").alias("new"))
        labels = materialize(labels.join(renamed, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")))
