"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.session import stage


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, label of every node of ``links``; nodes of a component share a label.

    Each round puts the nodes in a new order by hash, points every node to the first of itself and its
    neighbours, follows the pointers a few steps, and replaces the ends of all links by where they lead;
    links within a node go. Only nodes that come before all their neighbours are left: of a chain a third
    on average, however its nodes are numbered, and fewer of anything denser, so the rounds grow with the
    logarithm of the longest chain. They end when no link is left. Links may repeat, point either way or
    to their own start; a link with a null end is left out.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = links.select("a").union(links.select("b")).distinct()
    labels = nodes.select(F.col("a").alias("node"), F.col("a").alias("label"))
    links = stage(links.where("a <> b").distinct(), "round")
    n = 0
    while not links.isEmpty():
        n += 1

        def placed(node: str) -> Column:
            return F.struct(F.xxhash64(node, F.lit(n)).alias("place"), F.col(node).alias("to"))

        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(placed("b")).alias("first"))
        to = to.select(F.col("a").alias("node"), F.least("first", placed("a"))["to"].alias("to"))
        for _ in range(2):
            onward = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            to = to.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        to = stage(to, "pointers")
        labels = labels.join(to.select(F.col("node").alias("label"), "to"), "label", "left").select(
            "node", F.coalesce("to", "label").alias("label")
        )
        links = links.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        links = links.join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        links = stage(links.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "round")
    return stage(labels, "labels")
