"""Cluster bootstrap: resamples with replacement, weighed in one pass over the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Counts are drawn from numbers below this prime.
PRIME = 2**31 - 1
#: A count is the number of these that a number reaches: the Poisson distribution of mean 1, in PRIME parts.
REACHED = [math.ceil(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(10)]
#: Clusters weighed at once, and groups that a task holds before it hands on their sums.
AT_ONCE, GROUPS = 256, 256


def paired_losses(df: DataFrame, key: str, row: list[str], model: str, loss: str) -> DataFrame:
    """(a, b, key, difference) for each row that two models share: the loss of a less that of b, a the smaller name.

    A row is told by `key` and the columns `row`; it has one loss for each model.
    """
    side = lambda m, v: df.select(key, *row, F.col(model).alias(m), F.col(loss).alias(v))
    both = side("a", "_a").join(side("b", "_b"), [key, *row]).where("a < b")
    return both.select("a", "b", key, (F.col("_a") - F.col("_b")).alias("difference"))


def resampled_means(df: DataFrame, by: list[str], cluster: str, value: str, draws: int = 2_000) -> DataFrame:
    """(by, draw, n, below, mean): the mean of the clusters' means in every resample; draw 0 takes each cluster once.

    n and below are the clusters, and those whose mean is negative. In draw k a cluster counts as often as the Poisson
    distribution of mean 1 says for (c1 + k c2 + k^2 c3) mod PRIME, where c1 to c3 are taken from the MD5 digest of the
    cluster as text: resampling with replacement, without numbered rows or a table of draws, and the same on every run.
    Clusters are independent, and so are any three draws. A task adds up its clusters in arrays of a group, so only
    `draws` sums for each group leave it. Rows whose cluster or value is null (or whose value is NaN) are left out; a
    null in `by` is a group; an empty table gives no rows; a draw that takes no cluster has a null mean.
    """
    fine = df.where(F.col(cluster).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    digest = F.md5(F.col(cluster).cast("string"))
    parts = [(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % PRIME).alias(f"_c{at}") for at in (1, 9, 17)]
    clusters = fine.groupBy(*by, cluster).agg(F.avg(value).cast("double").alias("_v")).select(*by, "_v", *parts)
    width, reached = len(by), np.array(REACHED)
    schema = clusters.select(*by).schema.add("below", "long").add("weights", ArrayType(DoubleType())).add("totals", ArrayType(DoubleType()))
    names = schema.names

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        types = []

        def sums() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
            below, weights, totals = zip(*held.values())
            arrays = [pa.array(below, pa.int64()), *(pa.array(list(x), pa.list_(pa.float64())) for x in (weights, totals))]
            return pa.RecordBatch.from_arrays([*keys, *arrays], names=names)

        k = np.arange(draws + 1)
        for whole in batches:
            types = [whole.schema.field(i).type for i in range(width)]
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                v, c1, c2, c3 = (batch.column(i).to_numpy()[:, None] for i in range(width, width + 4))
                count = np.searchsorted(reached, (c1 + k * c2 + k * k * c3) % PRIME, "right").astype(float)
                count[:, 0] = 1
                keys = list(zip(*(batch.column(i).to_pylist() for i in range(width)))) or [()] * batch.num_rows
                place = {key: i for i, key in enumerate(dict.fromkeys(keys))}
                of = np.zeros((len(place), batch.num_rows))
                of[[place[key] for key in keys], np.arange(batch.num_rows)] = 1
                for key, below, weights, totals in zip(place, of @ (v[:, 0] < 0), of @ count, (of * v.T) @ count):
                    if key in held:
                        held[key] = [held[key][0] + int(below), held[key][1] + weights, held[key][2] + totals]
                    else:
                        held[key] = [int(below), weights, totals]
                if len(held) > GROUPS:
                    yield sums()
                    held = {}
        if held:
            yield sums()

    each = clusters.mapInArrow(weigh, schema).select(*by, "below", F.posexplode(F.arrays_zip("weights", "totals")).alias("draw", "_s"))
    each = each.groupBy(*by, "draw").agg(F.sum("below").alias("below"), F.sum("_s.weights").alias("_w"), F.sum("_s.totals").alias("_t"))
    n = F.max(F.when(F.col("draw") == 0, F.col("_w"))).over(Window.partitionBy(*by, F.lit(0)))  # draws + 1 rows of a group
    return each.select(*by, "draw", n.cast("long").alias("n"), "below", F.when(F.col("_w") > 0, F.col("_t") / F.col("_w")).alias("mean"))


def intervals(df: DataFrame, by: list[str], cluster: str, value: str, draws: int = 2_000, level: float = 0.95) -> DataFrame:
    """(by, n, observed, low, high, p_centred, p_signs, share_below) for each group of `by`; see resampled_means.

    low and high are percentiles of the resampled means. p_centred is the share of resamples that lie as far from the
    observed mean as that lies from zero, p_signs twice the smaller share of their signs, and share_below the share of
    clusters with a negative mean.
    """
    means = resampled_means(df, by, cluster, value, draws)
    observed = F.max(F.when(F.col("draw") == 0, F.col("mean"))).over(Window.partitionBy(*by, F.lit(0)))
    means = means.withColumn("observed", observed).where("draw > 0")
    share = lambda c: F.avg(c.cast("int"))
    m, low = F.col("mean"), (1 - level) / 2
    return means.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("observed").alias("observed"), F.percentile(m, low).alias("low"), F.percentile(m, 1 - low).alias("high"),
        share(F.abs(m - F.col("observed")) >= F.abs("observed")).alias("p_centred"), F.least(F.lit(1.0), 2 * F.least(share(m > 0), share(m < 0))).alias("p_signs"),
        F.first(F.col("below") / F.col("n")).alias("share_below"),
    )
