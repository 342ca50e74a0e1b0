"""Connected components of an edge table, by distributed label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .common import hot_keys, spread_join


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a, b``: long): the least
    node of its component. Nodes without an edge to another are left out.

    A round gives each node the least label among its neighbours and then the
    label's own label (pointer jumping), so chains halve in each round. Labels
    are written between rounds; minima are combined before the shuffle, and a label
    or hub that many nodes have is dealt over several tasks."""
    e = edges.where("a <> b").select("a", "b")
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(e.groupBy("a").agg(F.min("b").alias("m"))
                         .select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    hubs = hot_keys(e, ["b"])
    while True:
        near = (spread_join(e, labels.select(F.col("node").alias("b"), "label"), ["b"], ["a"], hot=hubs)
                .groupBy("a").agg(F.min("label").alias("m")))
        step = materialize(labels.join(near, labels.node == near.a).select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "label-step")
        to = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(spread_join(step, to, ["label"], ["node"], "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        moved = new.where("label <> old").limit(1).count()
        release(labels, step)
        labels = new.select("node", "label")
        if not moved:
            release(e)
            return labels
        labels._rarefold_path = new._rarefold_path
