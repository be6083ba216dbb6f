"""Helpers shared by the text and vector operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a derived table is broadcast; beyond it the join shuffles and adaptive execution splits skewed keys.
BROADCAST_ROWS = 50_000
#: One word: anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's shared checkpoint folder.

    The folder is spark.checkpoint.dir. Only a session with a local master may do without the setting; it then
    gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="matchloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def free_memory() -> None:
    """Hands what a Python task no longer uses back to the system; its worker stays for tasks of other kinds, which need room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # of the GNU library
        libc.malloc_trim(0)


def attach(df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of df with a derived table of unique keys: broadcast while that table is counted as small, else shuffled."""
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, keys, how)


#: Keys that are dealt out among all partitions at most, and the rows from which one is.
HOT_KEYS, HOT_ROWS = 1_000, 1_000


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """The keys of a table (key, n: rows) that have more than 1 in HOT_KEYS of all rows: so HOT_KEYS at most."""
    least = max(HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    return counts.where(F.col("n") > least).select(key).distinct()


def attach_skewed(df: DataFrame, side: DataFrame, hot: DataFrame, key: str, by: list[str], how: str = "inner") -> DataFrame:
    """Join of df with a derived table where the rows of the hot keys (see hot_keys) are dealt out among all partitions.

    They go by a hash of the columns `by`, and the side's rows are repeated for each part. The hot keys are broadcast.
    """
    ways = partitions(df.sparkSession)
    hot = F.broadcast(hot.select(key, F.lit(ways).cast("long").alias("_ways")))
    parts = F.when(F.col("_ways").isNull(), F.expr("array(0L)")).otherwise(F.expr(f"sequence(0L, {ways - 1}L)"))
    side = side.join(hot, key, "left").withColumn("_part", F.explode(parts)).drop("_ways")
    df = df.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*by), F.coalesce("_ways", F.lit(1).cast("long")))).drop("_ways")
    return df.join(side, [key, "_part"], how).drop("_part")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place from 0 in the global order, and without a single-task sort.

    Rows are dealt out by range, numbered inside each range, and shifted by the sizes of the ranges before. The ranges
    are kept by a checkpoint, so every later reader sees the same ones. Ties in `order` are numbered arbitrarily.
    """
    n = partitions(df.sparkSession)
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        dealt.withColumn("_place", place)
        .join(F.broadcast(shift), "_range")
        .withColumn(name, F.col("_shift") + F.col("_place") - 1)
        .drop("_range", "_place", "_shift")
    )


def hash60(*parts: Column) -> Column:
    """The first 60 bits of an MD5 digest, a number that other SQL engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def key_text(c: str) -> Column:
    """A record key as text; null has a text of its own."""
    return F.coalesce(F.col(c).cast("string"), F.lit("\\N"))
