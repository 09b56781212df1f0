"""Connected components of an edge table, by label spreading, root hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its
    smallest node.  Each round finds for every node the smallest label of the
    labels of itself and its neighbours; the node and the label it had both take it, so that
    whole trees hook onto each other and rounds grow with the logarithm of the longest
    path.  Rounds go on until no label moves; each is written to the shared folder."""
    both = (edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .where("a <> b").distinct())
    both = materialise(both.unionByName(both.select("a", F.col("a").alias("b")).distinct()), "cc-edges")     # each node its own neighbour
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "cc-labels")
    moved = True
    while moved:
        above = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("above")), "label")
        found = (both.join(above.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                 .agg(F.min("above").alias("found"), F.min(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("label")))
        told = found.select(F.explode(F.array(F.struct("node", "found", "label"),
                                              F.struct(F.col("label").alias("node"), "found", F.lit(None).cast("long").alias("label")))).alias("t"))
        new = materialise(told.select("t.*").groupBy("node").agg(F.min("found").alias("found"), F.min("label").alias("label"))
                          .select("node", F.col("found").alias("label"), (F.col("found") < F.col("label")).alias("moved")), "cc-labels")
        moved = not new.where("moved").isEmpty()
        labels = new.drop("moved")
    return labels.select("node", F.col("label").alias("component"))
