"""Connected components of a table of links, by contracting it round after round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node of the component.

    Each round points every node at its smallest neighbour or itself, follows that pointer once more, and puts the
    links between the nodes pointed at. Every node with a link loses itself or a neighbour, so the rounds are
    logarithmic in the number of nodes. Each round is written to the shared folder and read again, so lineage stays
    short and a lost executor costs one round. Links may repeat, be loops, or be missing altogether; null ends are
    ignored.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    found = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointed = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        next_hop = pointed.select(F.col("a").alias("b"), F.col("b").alias("root"))
        step = materialise(pointed.join(next_hop, "b").select(F.col("a").alias("node"), "root"), "components-step")
        if found is None:
            found = step
        else:
            follow = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            found = found.join(follow, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(left, "a").join(right, "b").where("ra <> rb")
        ends = moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        links = materialise(ends.distinct(), "components-links")
        if links.isEmpty():
            return found
