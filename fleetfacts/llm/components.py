"""Connected components of a table of links, by contraction; no link leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfacts.llm.common import cut_lineage


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (node, root) pointers, each to a smaller node, to their ends by doubling."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = cut_lineage(
            parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")),
            "roots",
        )
        parents = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the smallest of its component; `links` has columns a and b.

    Each round hooks every node to its smallest neighbour below it, follows the pointers, and goes on with the links
    between what is left. A node with any number of links is one row of an aggregate, never a list.
    """
    mapping = None
    while True:
        links = cut_lineage(
            links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links"
        )
        if mapping is not None and links.isEmpty():
            return mapping
        parents = _roots(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        of_a = parents.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        of_b = parents.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        links = links.join(of_a, "a", "left").join(of_b, "b", "left").select(
            F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
        )
        if mapping is None:
            mapping = parents
        else:
            moved = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            mapping = cut_lineage(
                mapping.join(moved, "root", "left").select("node", F.coalesce("above", "root").alias("root")).union(parents),
                "mapping",
            )
