"""A corpus from raw documents to token ids: language ID, near-dedup, secrets, mixing, SentencePiece.

Each stage works on what its predecessor kept. All but the last return the columns of documents, whatever else the
input holds, with nulls, repeated rows and empty tables treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import langid, mixing, pieces, secrets, simhash
from matchloom.llm.common import key_text, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter; null and empty texts go. A missing lang is filled in: with `und` if no row has
    a label to learn from. Ids may be null or repeat, and repeated rows stay. Columns beyond those of documents are dropped."""
    docs = docs.select(*COLUMNS)
    model = langid.learn(docs, "doc_id", "text", "lang")
    said = langid.identify(docs, "doc_id", "text", model, keep=["text", "lang", "source", "n_chars"])
    fine = F.col("lang_pred") != langid.UNKNOWN if model.labels else F.col("text").rlike(r"\p{L}")
    return said.where(fine).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null last; one of rows that are equal.

    SimHash links texts at 3 or fewer differing bits of 64; an exact check adds those of 0.8 and more that lie further apart.

    Rows are told apart by all their columns, so different texts stay, whether they share an id or have none.
    """
    keyed = docs.select(*COLUMNS).withColumn("_row", F.md5(F.to_json(F.struct(*COLUMNS))))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    groups = simhash.near_copies(keyed.select(key.alias("_key"), "text"), "_key", "text", words=5, similarity=0.8, bits=3)
    kept = groups.where(F.col("_key._row") == F.col("component_id._row")).select("_key._row").distinct()
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret. Null texts stay null; repeated rows and ids stay as they are."""
    out = secrets.redact(docs.select(*COLUMNS), "doc_id", "text", keep=["lang", "source"])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. Rows of one id and source are taken alike, null included."""
    keys = [key_text("doc_id").alias("_id"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_s")]
    times = mixing.mix(docs, "doc_id", "text", "source", mixing.WEIGHTS).where("copies > 0").select(*keys, "copies").distinct()
    rows = docs.select(*COLUMNS, *keys).join(times, ["_id", "_s"])
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with their count and digests; the digest of what they decode to. Null texts count as empty."""
    return pieces.encode(docs, "doc_id", "text", pieces.model_path()).drop("decoded")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", to_pieces),
]

#: SimHash, the network and SentencePiece are beyond SQL; tests/llm holds near_copies, redact, mix and the pieces against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
