"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of ``edges`` (a, b: any ordered type).

    Labels start as the nodes. In each round a node takes the least label next to it, and then the
    label of its label, so that chains halve. Rounds are equi-joins and minimum aggregates, which a
    node with very many neighbours does not burden; each is written to the shared folder, and the
    last is the one that changes nothing. No edges give no rows.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = settle(
            nearer.join(jump, "label").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("old")).alias("changed")), "labels"
        )
        if not labels.filter("changed").limit(1).count():
            return labels.select("node", "label")
        labels = labels.drop("changed")
