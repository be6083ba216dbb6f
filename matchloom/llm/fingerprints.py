"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import cut, ranked, table

#: Hashes of a paragraph. Each gives 8 lanes, one for each of its bytes; lanes are summed modulo 2 ** 32, two to a word.
HASHES, LANE_BITS = 8, 32
#: Paragraphs end at line breaks; those of prose are cut further at its marks, so that an edit changes few of them.
BREAKS = r"[\n.!?,;:|]+"
_LOW = (1 << LANE_BITS) - 1


def paragraphs(text: Column) -> Column:
    """The pieces between breaks; trim() takes the spaces around them off. The breaks themselves are no part of any piece.

    So a fingerprint tells neither the order of the pieces nor which marks stood between them: "a. b", "b! a" have the same.
    """
    return F.split(text, BREAKS)


def trim(piece: Column) -> Column:
    return F.btrim(piece, F.lit(" \t\n\x0b\f\r"))


def word_sums(piece: Column) -> list[Column]:
    """Sums of a column of paragraphs: words of two 32-bit lanes, each lane a sum of hash bytes.

    A word holds the sums of 8 million paragraphs, beyond which Spark's sum of longs fails; combine() adds up more.
    """
    mask = F.lit(0x000000FF_000000FF)
    counts = piece != ""
    out = []
    for i in range(HASHES):
        h = F.when(counts, F.xxhash64(piece, F.lit(i))).otherwise(F.lit(0).cast("long"))
        out += [F.sum(F.shiftrightunsigned(h, 8 * j).bitwiseAND(mask)).alias(f"w{4 * i + j}") for j in range(4)]
    return [*out, F.count(F.when(counts, 1)).alias("pieces")]


WORDS = [f"w{i}" for i in range(4 * HASHES)]


def lanes_of(words: Column) -> Column:
    """array<bigint> of all lanes, each from 0 to 2 ** 32 - 1, of an array of words."""
    return F.flatten(F.transform(words, lambda w: F.array(w.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(w, LANE_BITS))))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of a's paragraphs with b's put in (sign 1) or taken out (sign -1): a sum modulo 2 ** 32, in any order."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << LANE_BITS)))


def to_text(lanes: Column) -> Column:
    """Lanes in hexadecimal, 8 digits each."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """Cosine of two multisets as their lanes estimate it, 0 to 1: 1 for equal lanes, 0 where one is empty.

    A byte has the mean 127.5, so a lane less 127.5 for each paragraph adds up signed hashes; paragraphs that both
    have add to the product, all others cancel out but for noise of about 1 / sqrt(lanes).
    """
    dot = F.lit(0.0)
    pair = F.zip_with(a, b, lambda x, y: F.named_struct(F.lit("x"), x - 127.5 * n_a, F.lit("y"), y - 127.5 * n_b))
    sums = F.aggregate(
        pair, F.struct(dot.alias("xy"), dot.alias("xx"), dot.alias("yy")),
        lambda s, p: F.named_struct(F.lit("xy"), s["xy"] + p["x"] * p["y"], F.lit("xx"), s["xx"] + p["x"] * p["x"], F.lit("yy"), s["yy"] + p["y"] * p["y"]),
        lambda s: F.when((s["xx"] == 0) | (s["yy"] == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["xy"] / F.sqrt(s["xx"] * s["yy"])))),
    )
    return F.when(a == b, 1.0).otherwise(sums)


def fingerprint(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, words, pieces: one row for each combination of keys, over the paragraphs of all rows that have it.

    So rows may be whole texts or parts of them. A null text counts as empty; without paragraphs all lanes are 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(*keys, F.explode(paragraphs(text)).alias("_piece")).withColumn("_piece", trim(F.col("_piece")))
    sums = rows.groupBy(*keys).agg(*word_sums(F.col("_piece")))
    return sums.select(*keys, F.array(*WORDS).alias("words"), "pieces")


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_k, id, n_chars, copies, prev_k, text and the start of the next text, as much as a quarter of this one, as `head`.

    Rows are in the order of their ids, null first; rows of one id by a hash of the text; equal rows are one row with
    its number in `copies`. The last row's next is the first. Ids go through a global order; of the texts only the
    wanted starts are shuffled to the rows before them.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("_h", F.xxhash64("text")).withColumn("_k", F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.hex("_h")))
    ids = docs.groupBy("_k", "id", "_h").agg(F.max(F.length("text")).alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    placed = cut(ranked(ids, [F.col("id").asc_nulls_first(), F.col("_h")]))
    n = placed.count()
    before = placed.select(((F.col("rank") + 1) % max(n, 1)).alias("rank"), F.col("_k").alias("prev_k"), F.floor(F.col("n_chars") / 4).cast("int").alias("want"))
    chain = cut(placed.join(before, "rank").select("_k", "id", "n_chars", "copies", "prev_k", "want"))
    texts = docs.select("_k", "text")
    if n and not chain.where("copies > 1").isEmpty():
        texts = texts.dropDuplicates(["_k"])  # one row of each set of equal rows
    linked = texts.join(chain, "_k")
    heads = linked.select(F.col("prev_k").alias("_k"), F.expr("substring(text, 1, want)").alias("head"))
    return linked.drop("want").join(heads, "_k")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    kept = F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))")
    docs = docs.withColumn("edited", F.concat(kept, F.col("head")))
    row = ["_k", "id", "n_chars", "copies", "prev_k"]
    both = F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")))
    rows = docs.select(*row, F.sha2("edited", 256).alias("edited_sha256"), F.inline(both))
    prints = fingerprint(rows, [*row, "edited_sha256", "is_edited"], "text")
    side = lambda flag: F.max(F.when(F.col("is_edited") == flag, F.struct("words", "pieces")))
    one = cut(prints.groupBy(*row, "edited_sha256").agg(side(False).alias("own"), side(True).alias("edit")))
    after = one.select(F.col("prev_k").alias("_k"), F.col("own").alias("next"))
    lanes = {f"{c}_lanes": lanes_of(F.col(f"{c}.words")) for c in ("own", "edit", "next")}
    alike = lambda other: likeness(F.col("own_lanes"), F.col("own.pieces"), F.col(f"{other}_lanes"), F.col(f"{other}.pieces"))
    return one.join(after, "_k").withColumns(lanes).select(
        F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        to_text(F.col("own_lanes")).alias("fingerprint"), to_text(F.col("edit_lanes")).alias("edited_fingerprint"),
        alike("edit").alias("near_edited"), alike("next").alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
