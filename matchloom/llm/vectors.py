"""Embedding near-dedup: coarse inverted lists with product-quantised residuals, table distances, exact cosine rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import cut, hash60, partitions, table
from matchloom.llm.components import connected_components, local_roots

#: Vectors of a list at which the number of lists aims, and bounds of that number.
LIST_ROWS, LEAST_LISTS, MOST_LISTS = 192, 8, 4_096
#: The index is fitted on LIST_SAMPLE vectors a list and SAMPLE_VALUES components in all at most, and holds every vector.
LIST_SAMPLE, SAMPLE_VALUES = 16, 4_000_000
#: Vectors that are compared with all lists at once.
ROWS = 1_024
#: Subspaces of a residual, codewords of each, rounds of k-means.
SUBSPACES, CODEWORDS, ROUNDS = 8, 32, 8
#: Members of a bundle of neighbouring lists, and searches of it, that one task holds together.
BLOCK, SEARCHES = 2_048, 8_192
SEED = 11


@dataclass
class Index:
    dim: int
    lists: np.ndarray  # (n, dim)
    codes: np.ndarray  # (SUBSPACES, CODEWORDS, ceil(dim / SUBSPACES))
    reach: float  # the largest distance of two unit vectors of the wanted cosine
    bundles: np.ndarray  # the first list of each bundle

    def within(self, x: np.ndarray, home: np.ndarray, low: int, high: int) -> np.ndarray:
        """Which of the lists from low to high each vector searches: its own, and later ones whose border is within reach.

        The border is the plane between both centres. All that a list holds lies beyond it, so no partner is lost.
        """
        at, own = self.lists[low:high], self.lists[home]
        d = (at**2).sum(1)[None] - 2 * x @ at.T - ((own**2).sum(1) - 2 * (x * own).sum(1))[:, None]
        gaps = np.sqrt(np.maximum(0, (own**2).sum(1)[:, None] + (at**2).sum(1)[None] - 2 * own @ at.T))
        place = np.arange(low, high)[None]
        return (place == home[:, None]) | ((place > home[:, None]) & (d <= 2 * self.reach * gaps + 1e-9))

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Residuals (n, dim) cut into subspaces (n, SUBSPACES, width), filled up with zeros."""
        width = self.codes.shape[2]
        out = np.zeros((len(x), SUBSPACES * width))
        out[:, : self.dim] = x
        return out.reshape(len(x), SUBSPACES, width)

    def quantise(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, SUBSPACES) and the length of what they leave out."""
        codes, left = [np.zeros((0, SUBSPACES), np.uint8)], [np.zeros(0)]
        for at in range(0, len(residual), ROWS):
            p = self.parts(residual[at : at + ROWS])
            d = ((p[:, :, None, :] - self.codes[None]) ** 2).sum(3)
            code = d.argmin(2)
            codes.append(code.astype(np.uint8))
            left.append(np.sqrt(np.take_along_axis(d, code[:, :, None], 2)[:, :, 0].sum(1)))
        return np.concatenate(codes), np.concatenate(left)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector."""
    size = (centres**2).sum(1)[None]
    return np.concatenate([(size - 2 * x[at : at + ROWS] @ centres.T).argmin(1) for at in range(0, len(x), ROWS)] or [np.zeros(0, np.int64)])


def units(x: np.ndarray) -> np.ndarray:
    """Vectors, none of them zero, at length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def lists_for(rows: int) -> int:
    return min(max(rows // LIST_ROWS, LEAST_LISTS), MOST_LISTS)


def _chain(lists: np.ndarray) -> np.ndarray:
    """An order of the lists in which each is followed by the nearest that is left."""
    order, free = [0], np.ones(len(lists), bool)
    size = (lists**2).sum(1)
    for _ in range(len(lists) - 1):
        free[order[-1]] = False
        order.append(int(np.where(free, size - 2 * lists @ lists[order[-1]], np.inf).argmin()))
    return np.array(order)


def fit(sample: np.ndarray, rows: int, cosine: float) -> Index:
    """An index for `rows` vectors from a sample of unit vectors."""
    rng = np.random.default_rng(SEED)
    dim = sample.shape[1]
    lists = _kmeans(sample, lists_for(rows), rng)
    lists = lists[_chain(lists)]
    near = nearest(sample, lists)
    width = -(-dim // SUBSPACES)
    before = np.cumsum(np.bincount(near, minlength=len(lists))) * rows // (len(sample) * BLOCK)
    bundles = np.flatnonzero(np.concatenate(([True], before[:-1] != np.concatenate(([0], before[:-2])))))
    index = Index(dim, lists, np.zeros((SUBSPACES, CODEWORDS, width)), math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6, bundles)
    p = index.parts(sample - lists[near])
    index.codes = np.stack([_kmeans(p[:, m], CODEWORDS, rng) for m in range(SUBSPACES)])
    return index


def pairs_of(index: Index, x: np.ndarray, home: np.ndarray, code: np.ndarray, left: np.ndarray, q: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (search in q, member in x) of all pairs of at least the wanted cosine.

    Distances are asymmetric: a search keeps its full vector, a member is its list and its codes. The search's products with all
    codewords make a table, and its product with a member is that with the list plus a looked-up entry for each subspace. A
    member's true distance differs from that by no more than what its code leaves out, so no pair is lost; those that
    pass get their exact cosine, by one product where they are many.
    """
    own, place = np.unique(home, return_inverse=True)
    lists, codes = index.lists[own], index.codes
    inside = 2 * np.einsum("lmw,mcw->lmc", index.parts(lists), codes) + (codes**2).sum(2)[None]
    size = (lists**2).sum(1)[place] + sum(inside[place, m, code[:, m]] for m in range(SUBSPACES))  # squared lengths of what codes stand for
    # 1 + size - 2 q.known <= (reach + left)^2
    least = ((1 + size - np.square(index.reach + left)) / 2 - 1e-5).astype(np.float32)
    step = max(1, 2_000_000 // max(1, len(x)))
    for s in range(0, len(q), step):
        part = q[s : s + step]
        table = np.einsum("qmw,mcw->mqc", index.parts(part), codes).astype(np.float32)
        product = np.take((part @ lists.T).astype(np.float32), place, axis=1)
        for m in range(SUBSPACES):
            product += np.take(table[m], code[:, m], axis=1)
        near = product >= least[None, :]
        if np.count_nonzero(near) * 32 > near.size:
            a, b = np.nonzero(near & (part @ x.T >= cosine))
        else:
            a, b = np.nonzero(near)
            on = np.einsum("ij,ij->i", part[a], x[b]) >= cosine
            a, b = a[on], b[on]
        yield a + s, b


def near_vectors(df: DataFrame, id_col: str, vec_col: str, cosine: float = 0.95) -> DataFrame:
    """id, n_links, component_id, kept: one row for each row, linked with all others of a cosine of `cosine` or more.

    Equal vectors are one node of the index; they are linked with each other, and their number counts in n_links. A
    vector searches every list that can hold a partner, with no limit on their number: its own, and later ones whose
    border (the plane between both centres) is within reach. No link is lost, and each is found once. Neighbouring
    lists make a bundle, to which a vector goes once. Vectors of different lengths link with nothing of each other; each
    length has an index of its own (the driver holds the list of lengths). Vectors that are null, zero, or hold null or
    non-finite components link with nothing; their component_id is their id. Rows of one id count as two vectors. Long
    bundles are dealt out in blocks.
    """
    spark = df.sparkSession
    v = F.col("vec")
    single = dict(df.dtypes)[vec_col] == "array<float>"
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.select("id", F.when(fine, F.transform(v, lambda x: x + F.lit(0.0))).alias("vec"))
    out = rows.where("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for dim, n in sorted((r.dim, r.n) for r in rows.where("vec IS NOT NULL").groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()):
        out = out.union(_linked(spark, rows.where(F.size("vec") == dim), dim, cosine, single))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _linked(spark: SparkSession, rows: DataFrame, dim: int, cosine: float, single: bool) -> DataFrame:
    rows = rows.withColumn("key", F.md5(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")))
    nodes = rows.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.any_value("vec").alias("vec"))
    nodes = cut(nodes.withColumn("node", F.conv(F.substring("key", 1, 15), 16, 10).cast("long")))
    n = nodes.count()
    size = min(LIST_SAMPLE * lists_for(n), max(1, SAMPLE_VALUES // dim))
    sample = nodes.orderBy(hash60(F.col("key"), F.lit("sample"))).limit(size).select("vec").toPandas()
    index = fit(units(np.stack(sample.vec.to_numpy())), n, cosine)
    sent = spark.sparkContext.broadcast(astuple(index))  # plain arrays, as workers may lack this package; bounded by MOST_LISTS and CODEWORDS
    stored = "<f4" if single else "<f8"  # as the table has them, so nothing is lost

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = Index(*sent.value)
        ends = [*ix.bundles[1:].tolist(), len(ix.lists)]
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.iloc[at : at + ROWS]
                raw = np.stack(b.vec.to_numpy())
                x = units(raw)
                home = nearest(x, ix.lists)
                some = np.stack([ix.within(x, home, low, high).any(1) for low, high in zip(ix.bundles.tolist(), ends)], 1)
                bundle = np.searchsorted(ix.bundles, home, "right") - 1
                code, left = ix.quantise(x - ix.lists[home])
                visits = [np.flatnonzero(r).astype(np.int32) for r in some]
                yield pd.DataFrame({"node": b.node, "copies": b.copies, "unit": [r.tobytes() for r in raw.astype(stored)], "home": home, "bundle": bundle, "code": [c.tobytes() for c in code], "left": left, "visits": visits})

    kinds = "node long, copies long, unit binary, home int, bundle int, code binary, left double, visits array<int>"
    placed = cut(nodes.select("node", "copies", "vec").mapInPandas(place, kinds))
    load = placed.groupBy(F.col("bundle").alias("at")).agg(F.count(F.lit(1)).alias("members"))
    load = load.join(placed.select(F.explode("visits").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("searches")), "at")
    load = load.select("at", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("searches") / SEARCHES).cast("int").alias("turns"))
    load = F.broadcast(cut(load))  # a row for each bundle
    block = lambda c, k: F.pmod(F.xxhash64("node", F.lit(k)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = placed.join(load, placed.bundle == load["at"]).select(F.lit(0).alias("role"), "at", block("blocks", 1).alias("block"), every("turns").alias("turn"), "node", "copies", "home", "unit", "code", "left")
    none = [F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("left")]
    searches = placed.withColumn("at", F.explode("visits")).join(load, "at").select(F.lit(1).alias("role"), "at", every("blocks").alias("block"), block("turns", 2).alias("turn"), "node", "copies", "home", "unit", *none)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        ix, at = Index(*sent.value), int(group["at"].iloc[0])
        m, q = group[group.role == 0], group[group.role == 1]
        if m.empty or q.empty:
            return pd.DataFrame({"node": [], "links": [], "root": []})
        x, y = (units(np.frombuffer(b"".join(g.unit), stored).reshape(len(g), ix.dim)) for g in (m, q))
        code, left, home = np.frombuffer(b"".join(m.code), np.uint8).reshape(len(m), SUBSPACES), m.left.to_numpy(), m.home.to_numpy()
        qn, mn, qc, mc = q.node.to_numpy(), m.node.to_numpy(), q.copies.to_numpy(), m.copies.to_numpy()
        own = q.home.to_numpy()
        names, inverse = np.unique(np.concatenate((qn, mn)), return_inverse=True)
        iq, im = inverse[: len(qn)], inverse[len(qn) :]
        n_links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        for a, b in pairs_of(ix, x, home, code, left, y, cosine):
            # a pair of two lists is the earlier one's search; within a list each pair shows up from both ends
            on = (own[a] < home[b]) | ((own[a] == home[b]) & (qn[a] < mn[b]))
            ia, ib = iq[a[on]], im[b[on]]
            np.add.at(n_links, ia, mc[b[on]])
            np.add.at(n_links, ib, qc[a[on]])
            apart = root[ia] != root[ib]
            if apart.any():
                root = local_roots(len(names), root[ia[apart]], root[ib[apart]])[root]
        on = n_links > 0
        return pd.DataFrame({"node": names[on], "links": n_links[on], "root": names[root][on]})

    tasks = members.unionByName(searches).repartition(partitions(spark), "at", "block", "turn")
    found = cut(tasks.groupBy("at", "block", "turn").applyInPandas(search, "node long, links long, root long"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = nodes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    known = nodes.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return rows.select("id", "key").join(known, "key").select("id", "n_links", "component_id")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.95)
