"""Connected components of links between integer ids, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the least node of its component.

    Labels spread over links and jump along labels until none changes.  Every
    round is written to the shared folder, so no lineage grows.  Nodes with very
    many links are reduced in each task before the shuffle.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = narrow(both.where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = narrow(edges.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(
            F.min("label").alias("near"))
        spread = narrow(labels.join(near.withColumnRenamed("b", "node"), "node").select(
            "node", F.least("label", "near").alias("next"), "label"), "labels-spread")
        target = spread.select(F.col("node").alias("next"), F.col("next").alias("far"))
        labels = narrow(spread.join(target, "next").select(
            "node", F.col("far").alias("label"),
            (F.col("far") != F.col("label")).alias("changed")), "labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
