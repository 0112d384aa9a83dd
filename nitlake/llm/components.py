"""Connected components of a link table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_key, discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another; ``root`` is the smallest node reachable.

    Each round every node hooks onto its smallest neighbour, chains are shortened by doubling, and
    the links are redrawn between the roots that are left; at least half of the linked nodes go
    each round. Nothing gathers a node's neighbours: sums are minima, which Spark combines before
    it shuffles, and joins meet a table with one row per node, so a hub's rows can be split.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = stored(links.distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        parents = stored(hooked.select("node", F.least("node", "root").alias("root")), "parents")
        while True:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = stored(
                parents.join(by_key(above), "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")),
                "parents",
            )
            discard(parents)
            parents = jumped
            if parents.where("moved").isEmpty():
                break
        parents = parents.drop("moved")
        steps.append(jumped)
        one = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        other = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = edges.join(by_key(one), "a").join(by_key(other), "b").where("ra <> rb")
        left = left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        redrawn = stored(left, "links")
        discard(edges)
        edges = redrawn
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].select("node", "root")
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("later"))
        found = found.join(by_key(later), "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return found
