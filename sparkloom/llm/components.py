"""Connected components of a link table, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node long, label long) of every node that has a link; label is the least node reachable.

    ``links`` has the columns a and b and must be a written table.  Each round takes the least label
    among a node's neighbours (pre-aggregated before its shuffle) and then jumps to the label's own
    label, so the rounds needed grow with the logarithm of a component's diameter.  Nothing is
    collected but one flag a round.  An empty table gives an empty table.
    """
    edges = scratch.keep(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        f"{name}-edges",
    )
    labels = scratch.keep(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), f"{name}-0"
    )
    turn = 0
    while True:
        turn += 1
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        near = scratch.keep(
            labels.select("node", "label", F.col("label").alias("old"))
            .unionByName(heard.select("node", "label", F.lit(None).cast("long").alias("old")))
            .groupBy("node")
            .agg(F.min("label").alias("label"), F.max("old").alias("old")),
            f"{name}-near-{turn}",
        )
        up = near.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = scratch.keep(
            near.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), f"{name}-{turn}"
        )
        scratch.drop(f"{name}-near-{turn}", f"{name}-{turn - 1}")
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            scratch.drop(f"{name}-edges")
            return labels
