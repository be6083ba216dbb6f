"""Connected components of link tables, and the same inside one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import cut, partitions

#: Edges that a task replaces by a forest at once, and that a part of a link table holds.
AT_ONCE = 1 << 20


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of `edges` (a, b: long): root is the smallest node of its component.

    Each task first replaces its edges by a forest of stars, so that edges that lie together anyway do not move. What
    is left is counted and gathered in parts of about AT_ONCE edges, each made a forest again; one part is the result.
    Else alternating large-star and small-star steps follow; each round is a few joins on the edges, whose number never
    grows, and ends in a checkpoint of as many parts. Minima are aggregated before the shuffle, and the join back has
    one row for each node on one side, so a hub is split like any skewed key. Loops, repeated edges and nulls are
    dropped; no edges give no rows.
    """
    forest = lambda df: df.mapInArrow(_forest, "a long, b long")
    e = cut(forest(edges.where("a <> b").select("a", "b")))
    ways = max(1, -(-e.count() // AT_ONCE))
    gathered = lambda df: df.coalesce(ways) if ways < partitions(df.sparkSession) else df
    e = forest(gathered(e))
    e = cut(e if ways == 1 else gathered(e.distinct()))
    while ways > 1 and not _stars(e):
        both = e.selectExpr("stack(2, a, b, b, a) AS (a, b)")  # both directions, from one pass
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("stack(2, b, m, a, m) AS (a, b)")
        e = cut(gathered(small.where("a <> b").distinct()))
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(e.select("b", "b").distinct())


def _stars(e: DataFrame) -> bool:
    """Whether distinct edges (a > b) are stars: each a has one edge, and none is the b of another."""
    ends = e.selectExpr("stack(2, a, 1, 0, b, 0, 1) AS (n, up, down)")
    ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up + down > 1 AND up > 0").agg(F.count(F.lit(1))).first()[0] == 0


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as stars around the smallest node of each of their components, AT_ONCE edges and more at a time."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = node[local_roots(len(node), at[: len(a)], at[len(a) :])]
        return pa.RecordBatch.from_arrays([pa.array(node[root < node]), pa.array(root[root < node])], names=["a", "b"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= AT_ONCE:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' components, for links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
