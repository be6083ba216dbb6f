"""Hierarchical shrinkage of a fitted forest, from its table of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nodes_of(spark: SparkSession, model, path: str) -> DataFrame:
    """(tree, id, left, right, n, mean): the nodes of a classifier saved at path; mean holds the class shares, left is -1 in a leaf."""
    model.save(path)
    data = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    return data.select("tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("rawCount").alias("n"), F.transform("impurityStats", lambda x: x / total).alias("mean"))


def _moved(shrunk: Column, mean: Column, parent: Column, n: Column, lambdas: Column) -> Column:
    """Per lambda: the parent's shrunk shares and the step to the node's own, the smaller the fewer rows the parent has."""
    step = lambda s, lam: F.zip_with(s, F.zip_with(mean, parent, lambda a, b: a - b), lambda v, g: v + g / (1 + lam / n))
    return F.zip_with(shrunk, lambdas, step)


def shrink(nodes: DataFrame, lambdas: list[float], depth: int) -> DataFrame:
    """(tree, leaf, shrunk): for each lambda the shares of a leaf, shrunk towards those of the nodes above it.

    Shares are handed down from the roots, one join a level. A leaf's number is its rank by id, as in a model's leafCol.
    Trees of no more than a root have one leaf. The table is bounded by the trees and their depth, not by the data.
    """
    lams = F.array(*[F.lit(float(v)) for v in lambdas])
    level = nodes.where("id = 0").withColumn("shrunk", F.transform(lams, lambda _: F.col("mean")))
    leaves = level.where("left < 0")
    for _ in range(depth):
        up = level.where("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("n_up"), F.col("mean").alias("mean_up"), F.col("shrunk").alias("s"))
        level = nodes.join(up, ["tree", "id"]).withColumn("shrunk", _moved(F.col("s"), F.col("mean"), F.col("mean_up"), F.col("n_up"), lams)).drop("s", "n_up", "mean_up")
        leaves = leaves.unionByName(level.where("left < 0"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("id")) - 1
    return leaves.select("tree", rank.alias("leaf"), "shrunk")


def score(rows: DataFrame, row_id: str, leaf: str, shrunk: DataFrame, keep: list[str]) -> DataFrame:
    """(row_id, keep, place, p): for each lambda, by its place in the list, the mean over trees of the shares of a row's leaves.

    `leaf` is the model's vector of leaf numbers as an array.
    """
    fallen = rows.select(row_id, *keep, F.posexplode(leaf).alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))
    each = fallen.join(F.broadcast(shrunk), ["tree", "leaf"]).select(row_id, *keep, F.posexplode("shrunk").alias("place", "s"))
    classes = range(3)
    mean = F.array(*[F.avg(F.col("s")[i]) for i in classes])
    return each.groupBy(row_id, *keep, "place").agg(mean.alias("p"))
