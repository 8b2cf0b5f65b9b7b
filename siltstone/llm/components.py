"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges``.

    Each round takes the smallest label of a node and its neighbours, then follows the label's own label; the rounds
    needed grow with the logarithm of a component's diameter in practice. Labels are written to the shared folder
    each round, those of the round before go, and only whether a row changed reaches the driver. Self loops are ignored, an empty table gives an empty result.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = common.store(one.unionAll(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels, place = common.store_at(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    if not labels.take(1):
        return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("u").alias("label"), F.col("label").alias("up"))
        moved = step.join(up, "label", "left").select("u", "was", F.least("label", F.coalesce("up", "label")).alias("label"))
        moved, new = common.store_at(moved, "labels")
        common.remove(place)
        labels, place = moved.select("u", "label"), new
        if not moved.filter("label <> was").take(1):
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
