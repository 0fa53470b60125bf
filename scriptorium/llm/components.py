"""Distributed connected components, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b -> id, component (the smallest id that can be reached), for every id in a link.

    Labels pass to neighbours and then jump to their label's label, until nothing changes; each round is written to the
    shared folder, and the one before it deleted. Minima are combined before each shuffle, so a node with very many links is no single task.
    """
    edges = cut(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))).where("src <> dst").distinct())
    table = labels = cut(edges.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("component")).withColumnRenamed("src", "id"))
    while True:
        near = edges.join(labels, edges["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("near"))
        passed = labels.join(near, labels["id"] == near["src"], "left").select("id", F.least("component", F.coalesce("near", "component")).alias("label"), F.col("component").alias("was"))
        target = labels.select(F.col("id").alias("label"), F.col("component").alias("jump"))
        after = cut(passed.join(target, "label", "left").select("id", F.least("label", F.coalesce("jump", "label")).alias("component"), "was"))
        drop(table)
        table, labels = after, after.select("id", "component")
        if after.where("component <> was").isEmpty():
            drop(edges)
            return labels
