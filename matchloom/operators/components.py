"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.sources.files import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the smallest node that can be reached, for every node of an edge, a loop's too.

    Each round hangs every node, and what it hangs from, on the smallest node that is known among its neighbours, then skips to what that hangs
    from; so distances about halve, and it ends when nothing moves. Rounds are kept in the shared folder. Null ends are left out.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    both = kept(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = kept(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = both.join(at.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("c"))
        own = at.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        hung = own.select(F.col("old").alias("node"), "c").unionByName(own.select("node", "c")).groupBy("node").agg(F.min("c").alias("c"))
        up = hung.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        moved = hung.join(up, "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("component"))
        new = kept(at.withColumnRenamed("component", "old").join(moved, "node").select("node", F.least("old", "component").alias("component"), (F.col("component") < F.col("old")).alias("_moved")))
        if new.where("_moved").isEmpty():
            return new.drop("_moved")
        at = new.drop("_moved")
