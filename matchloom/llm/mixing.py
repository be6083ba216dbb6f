"""Mixing sources to target weights: hash-threshold histograms instead of a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import WORD, attach, cut, hash60, key_text, ranked, table

#: A hash has 60 bits; each level of the histogram looks at BITS more of them.
HASH_BITS, BITS = 60, 10


def targets(totals: DataFrame, weights: list[float], budget: float, cap: float) -> DataFrame:
    """totals (source, source_size) with target: shares of `budget` times all sizes by weight, none above `cap` times its source.

    Weights repeat over the sources by code point, null last. What a cap cuts off is shared again by weight until no
    target is above its cap; a round is one aggregation over the sources, and only sums reach the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    s = cut(ranked(totals, order).select("source", "source_size", w.alias("w"), (F.col("source_size") * cap).alias("top")))
    total = budget * (s.agg(F.sum("source_size")).first()[0] or 0)
    capped, n = F.lit(False), -1
    while True:
        now = s.agg(
            F.coalesce(F.sum(F.when(capped, F.col("top"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0.0)),
            F.count(F.when(capped, 1)),
        ).first()
        rest, share = total - now[0], now[1]
        if now[2] == n or share == 0:
            break
        n = now[2]
        capped = F.col("top") * F.lit(share) <= F.lit(rest) * F.col("w")  # the level only rises, so none gets free again
    free = F.lit(rest) * F.col("w") / F.lit(share) if share else F.col("top")
    return s.select("source", "source_size", F.when(capped, F.col("top")).otherwise(free).alias("target"))


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: list[float], budget: float = 1.5, cap: int = 2) -> DataFrame:
    """One row for each input row: id, size, source_size, target, taken, source and copies.

    size counts words (null text: 0). A source takes every document target // source_size times, and once more those
    whose hash is under the source's threshold. The threshold comes from sums by source and hash bucket; only the
    bucket that holds the boundary is refined, by further bits of the hash, until it holds one hash, which is taken
    if that brings the source nearer to its target. Rows of one id share a hash, so they are taken together and a run
    can be repeated. Null ids and null sources are values like others; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = cut(
        df.select(
            F.col(id_col), F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("_s"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            hash60(key_text(id_col), F.lit("mix")).alias("_h"),
        )
    )
    totals = rows.groupBy("_s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = targets(totals.select("source", "source_size"), weights, budget, cap).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_s"), "source_size", "target"
    )
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = cut(goal.withColumn("_copies", copies).withColumn("_need", F.col("target") - F.col("_copies") * F.col("source_size")))
    # the boundary of each source: hashes under _from are taken, _need words more are wanted from _depth bits on
    open_, done = goal.select("_s", "_need", F.lit(0).cast("long").alias("_from")), None
    depth = 0
    while depth < HASH_BITS:
        depth += BITS
        shift = HASH_BITS - depth
        inside = F.shiftright(F.col("_h"), shift + BITS) == F.shiftright(F.col("_from"), shift + BITS)
        hist = (
            attach(rows.select("_s", "_h", "size"), open_, ["_s"]).where(inside)
            .groupBy("_s", "_need", F.shiftright("_h", shift).alias("_b"))
            .agg(F.sum("size").alias("_n"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
        )
        past = F.sum("_n").over(Window.partitionBy("_s").orderBy("_b"))  # 2 ** BITS rows of a source at most
        edge = hist.withColumn("_past", past).where("_need >= _past - _n AND _need < _past")
        edge = cut(edge.select("_s", (F.col("_need") - F.col("_past") + F.col("_n")).alias("_need"), F.shiftleft("_b", shift).alias("_from"), "_n", "_lo", "_hi"))
        single = F.col("_lo") == F.col("_hi")
        takes = F.when(2 * F.col("_need") >= F.col("_n"), F.col("_lo") + 1).otherwise(F.col("_lo"))
        ended = edge.where(single).select("_s", takes.alias("_below"))
        done = ended if done is None else done.union(ended)
        open_ = edge.where(~single).select("_s", "_need", "_from")
        if open_.isEmpty():
            break
    marks = goal.join(done, "_s", "left").select("_s", "source_size", "target", "_copies", F.coalesce("_below", F.lit(0).cast("long")).alias("_below"))
    times = F.col("_copies") + (F.col("_h") < F.col("_below")).cast("long")
    return attach(rows, marks, ["_s"]).select(
        id_col, "size", "source_size", "target", (F.col("size") * times).alias("taken"), "source", times.alias("copies")
    )


WEIGHTS = [3.0, 1.0, 2.0]


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", WEIGHTS).drop("source", "copies")


SQL = """
WITH RECURSIVE base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N') || '|mix'), 1, 15))::BIGINT AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM base GROUP BY source),
r AS (SELECT *, sum(2 * source_size) OVER o AS caps, sum(w) OVER (ORDER BY 2 * source_size / w DESC, source NULLS LAST) AS ws, 1.5 * sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST)),
lvl AS (SELECT min(CASE WHEN 2 * source_size * ws > (total - caps + 2 * source_size) * w THEN (total - caps + 2 * source_size)::DOUBLE / ws END) AS level,
  min_by(total - caps + 2 * source_size, 2 * source_size / w) FILTER (WHERE 2 * source_size * ws > (total - caps + 2 * source_size) * w) AS rest,
  min_by(ws, 2 * source_size / w) FILTER (WHERE 2 * source_size * ws > (total - caps + 2 * source_size) * w) AS share FROM r),
t AS (SELECT source, source_size, CASE WHEN share IS NULL OR 2 * source_size * share <= rest * w THEN 2.0 * source_size ELSE rest::DOUBLE * w / share END::DOUBLE AS target FROM s, lvl),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
c AS (SELECT b.*, n.source_size, n.target, n.copies, n.target - n.copies * n.source_size AS need,
  sum(size) OVER (PARTITION BY b.source ORDER BY h) AS past FROM base b JOIN n ON b.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
  size * (copies + CASE WHEN past <= need OR 2 * (need - past + size) >= size AND past - size <= need THEN 1 ELSE 0 END)::BIGINT AS taken FROM c
"""
