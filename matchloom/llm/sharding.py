"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import cut, hash60, key_text, table

#: Rows of a shard that are numbered together.
BLOCK_ROWS = 2_000


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, whose score -ln(u) / weight is least; u comes from the key and the shard's number.

    Only key, shard number and weight count, so another shard takes records only into itself, and a record moves with
    a probability of that shard's share. A shard of weight 0 or less takes none.
    """
    scores = [
        F.struct((-F.log((hash60(key, F.lit(str(s))) + 1) / F.lit(2.0**60)) / F.lit(float(w))).alias("score"), F.lit(s).alias("s"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*scores))["s"]


def shard(df: DataFrame, id_col: str, text_col: str, weights: list[float]) -> DataFrame:
    """One row for each input row: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; a null text counts as empty (size 8, crc 0). Slots number a shard's rows
    from 0 without gaps in the order of a hash of the key, then key, crc and size; they are counted in blocks of the
    hash's range, so no task gets a whole shard. Records of one key go to one shard; null is a key of its own. An
    empty table gives no rows. grown_shard is the shard with one more shard of the mean weight.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = [*weights, sum(weights) / len(weights)]
    rows = cut(
        df.select(
            F.col(id_col),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            key_text(id_col).alias("_key"),
        ).select(
            id_col, "size", "text_crc32",
            rendezvous(F.col("_key"), weights).alias("shard"),
            rendezvous(F.col("_key"), more).alias("grown_shard"),
            hash60(F.col("_key"), F.lit("slot")).alias("_h"),
        )
    )
    n = rows.count()
    bits = max(0, (n // (BLOCK_ROWS * len(weights))).bit_length())
    rows = rows.withColumn("_block", F.shiftright("_h", 60 - bits) if bits else F.lit(0).cast("long"))
    sizes = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_h", id_col, "text_crc32", "size"))
    return (
        rows.withColumn("_place", place)
        .join(shift, ["shard", "_block"])
        .select(
            id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("_shift") + F.col("_place") - 1).alias("slot"), "grown_shard",
        )
    )


SHARDS = 24


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS)


def _h(*parts: str) -> str:
    return f"('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 15))::BIGINT"


_KEY = "coalesce(doc_id::VARCHAR, '\\N')"

SQL = f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
base AS (
  SELECT doc_id, {_KEY} AS key, (strlen(coalesce(text, '')) + 8)::BIGINT AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT) AS bytes
  FROM documents),
scored AS (
  SELECT doc_id, key, size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32,
    list_transform(range({SHARDS + 1}), lambda s: {_h("key", "s::VARCHAR")}) AS u
  FROM base, crc_table),
placed AS (
  SELECT *, {_h("key", "'slot'")} AS h,
    (list_position(u[1:{SHARDS}], list_max(u[1:{SHARDS}])) - 1)::INT AS shard, (list_position(u, list_max(u)) - 1)::INT AS grown_shard FROM scored)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM placed
"""
