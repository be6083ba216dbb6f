"""Spelling variants: words one edit apart, found by probing edits against Bloom filters before an exact join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import cut, table

#: Letters that make up a word.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Bits of the filters for each word, and set by each; a block is one 64-bit number.
BITS_A_WORD, BITS_SET = 16, 4
#: Blocks of a segment, the part of a filter that one task fills, and bytes of all filters that are broadcast together.
SEGMENT, FILTER_BYTES = 1 << 13, 64 << 20
#: Words that a task handles at the same time.
CHUNK = 1_000
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def letter_hash(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The share of a letter in its word's hash, which is the exclusive or of all shares."""
    return mixed((place.astype(_U) << _U(32)) + code.astype(_U) + _U(0x9E3779B97F4A7C15))


def codes_of(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def place_of(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of a hash, and its bits in it."""
    h = mixed(h)
    block = ((h >> _U(32)) * _U(blocks)) >> _U(32)
    bits = np.zeros_like(h)
    for i in range(BITS_SET):
        bits |= _U(1) << ((h >> _U(6 * i)) & _U(63))
    return block, bits


def word_hash(codes: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(letter_hash(np.arange(codes.shape[1]), codes), axis=1)


def deletions(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, which words, hashes) of words of one length without the letter at that place; once where letters repeat."""
    n = codes.shape[1]
    here = letter_hash(np.arange(n), codes)
    moved = letter_hash(np.arange(n - 1), codes[:, 1:])  # the shares of letters that go one place to the left
    before, after = np.bitwise_xor.reduce(here, axis=1), np.zeros(len(codes), _U)
    for i in range(n - 1, -1, -1):
        before = before ^ here[:, i]
        some = np.arange(len(codes)) if i == n - 1 else np.flatnonzero(codes[:, i] != codes[:, i + 1])
        yield i, some, (before ^ after)[some]
        if i:
            after = after ^ moved[:, i - 1]


def replacements(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, which words, which letters, hashes) of words of one length with a later letter of the alphabet at that place."""
    here = letter_hash(np.arange(codes.shape[1]), codes)
    whole = np.bitwise_xor.reduce(here, axis=1)
    for i in range(codes.shape[1]):
        letter, some = np.nonzero(codes[:, i] < alphabet[:, None])
        yield i, some, letter, (whole ^ here[:, i])[some] ^ letter_hash(np.array(i), alphabet)[letter]


def segments(words: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """The filled segments (length, segment, bits) of the filters of words (word, length): each by the task that has its words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for length, rows in frame.groupby("length"):
                block, bits = place_of(word_hash(codes_of(rows["word"].tolist(), length)), blocks[length])
                names = ["length", "segment", "block", "mask"]
                same = pa.array(np.full(len(rows), length, np.int32))
                yield pa.RecordBatch.from_arrays([same, pa.array((block // _U(SEGMENT)).astype(np.int32)), pa.array((block % _U(SEGMENT)).astype(np.int32)), pa.array(bits.view(np.int64))], names=names)

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(SEGMENT, _U)
        np.bitwise_or.at(out, rows["block"].to_numpy(), rows["mask"].to_numpy().view(_U))
        return pd.DataFrame({"length": [key[0]], "segment": [key[1]], "bits": [out.tobytes()]})

    masks = words.select("word", "length").mapInArrow(hashed, "length int, segment int, block int, mask long")
    return masks.groupBy("length", "segment").applyInPandas(fill, "length int, segment int, bits binary")


def filters(words: DataFrame, sizes: dict[int, int]) -> Broadcast:
    """Blocked Bloom filters of words (word, length), one for each length, broadcast: FILTER_BYTES and a segment a length at most."""
    blocks = {n: max(1, -(-size * BITS_A_WORD // 64)) for n, size in sizes.items()}
    made = {n: np.zeros(-(-b // SEGMENT) * SEGMENT, _U) for n, b in blocks.items()}
    for r in segments(words, blocks).collect():
        made[r.length][r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(bytes(r.bits), _U)
    return words.sparkSession.sparkContext.broadcast({n: (made[n], b) for n, b in blocks.items()})


def probe(words: DataFrame, known: Broadcast, alphabet: list[int]) -> DataFrame:
    """(word, n, edit) for each edit of words (word, n, length) that the filters do not rule out: all true ones, and some false.

    Edits are deletions, and replacements by a later letter. An insertion is a deletion of the other word, and a replacement by an
    earlier letter one of the other word, so each pair of words one edit apart is met exactly once. An edit's hash takes two
    steps from its word's, and only those that pass are spelled out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = known.value
        letters = np.array(alphabet, np.uint32)

        def passes(size: int, h: np.ndarray) -> np.ndarray:
            bits, blocks = filled[size]
            block, mask = place_of(h, blocks)
            return np.flatnonzero((bits[block.astype(np.intp)] & mask) == mask)

        for batch in batches:
            frame = batch.to_pandas()
            for length, every in frame.groupby("length"):
                for at in range(0, len(every), CHUNK):
                    rows = every.iloc[at : at + CHUNK]
                    texts = rows["word"].tolist()
                    codes = codes_of(texts, length)
                    hits: list[tuple[int, str]] = []
                    if length - 1 in filled:
                        for i, some, h in deletions(codes):
                            hits += [(k, texts[k][:i] + texts[k][i + 1 :]) for k in some[passes(length - 1, h)]]
                    if length in filled:
                        for i, some, letter, h in replacements(codes, letters):
                            yes = passes(length, h)
                            hits += [(k, f"{texts[k][:i]}{chr(c)}{texts[k][i + 1 :]}") for k, c in zip(some[yes], letters[letter[yes]])]
                    if hits:
                        which = [k for k, _ in hits]
                        yield pa.RecordBatch.from_arrays([pa.array([texts[k] for k in which]), pa.array(rows["n"].to_numpy()[which]), pa.array([e for _, e in hits])], names=["word", "n", "edit"])

    return words.select("word", "n", "length").mapInArrow(run, "word string, n long, edit string")


def near_words(words: DataFrame) -> DataFrame:
    """Both directions (word, near, near_n) of every pair of words (word, n) that differ by one deleted, inserted or replaced code point.

    The filters stand for at most FILTER_BYTES; a larger vocabulary is probed in several passes, each against a part of
    it by a hash. What they let through is joined with the vocabulary, so no false pair remains.
    """
    words = words.select("word", "n", F.length("word").alias("length"))
    alphabet = sorted(ord(r[0]) for r in words.select(F.explode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("c")).distinct().collect())
    total = words.count()
    passes = -(-total * BITS_A_WORD // (8 * FILTER_BYTES)) or 1
    pairs = None
    for i in range(passes):
        part = words.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == i) if passes > 1 else words
        sizes = {r[0]: r[1] for r in part.groupBy("length").count().collect()}
        if not sizes:
            continue
        maybe = probe(words, filters(part, sizes), alphabet)
        found = maybe.join(part.select(F.col("word").alias("edit"), F.col("n").alias("m")), "edit")
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    both = F.array(F.struct("word", F.col("edit").alias("near"), F.col("m").alias("near_n")), F.struct(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(both))


def roots(links: DataFrame) -> DataFrame:
    """links (word, form) with root, the end of the way over forms. Each round doubles the steps taken, so it takes few:
    a form is used several times as often as its word, and no way is longer than the logarithm of the largest count."""
    out = cut(links.select("word", "form", F.col("form").alias("root")))
    while True:
        on = out.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        out = cut(out.join(on, "root", "left").select("word", "form", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if out.where("_moved").isEmpty():
            return out.drop("_moved")
        out = out.drop("_moved")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of a vocabulary (word: unique, n).

    n_near counts the words one edit away. form is that of largest n, of equal ones the first in code-point order, if its
    n is at least `ratio` times the word's; else null. root is where following forms ends, the word itself without a
    form. An empty vocabulary gives no rows; other columns are dropped, whatever their names. Words may have any length and letters.
    """
    words = cut(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    said = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("b.m")).alias("form_n"), F.col("b.near").alias("form"))
    fits = F.col("form_n") >= ratio * F.col("n")
    said = cut(said.select("word", "n", "n_near", F.when(fits, F.col("form_n")).alias("form_n"), F.when(fits, F.col("form")).alias("form")))
    ends = roots(said.where("form IS NOT NULL").select("word", "form"))
    return said.join(ends.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(df: DataFrame, id_col: str, text_col: str, every: int = 199, least_chars: int = 6, least_rows: int = 5) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z lower-cased, with at least least_chars code points and least_rows occurrences.

    Where `every` divides the CRC-32 of `<id>:<run>`, the run loses the code point at that number modulo its length. A null text
    has no runs, a null id counts as empty, and repeated rows count again. Counts are summed before they are shuffled.
    """
    runs = F.explode(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(LETTERS), F.lit(0)))
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), runs.alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (h % F.length("_run")).cast("int")
    shorter = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    rows = rows.where(F.length("_run") >= least_chars).select(F.when(h % every == 0, shorter).otherwise(F.col("_run")).alias("word"))
    return rows.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text"))


SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: ('0x' || x)::UBIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS h FROM counted, crc_table),
kept AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, i, left(word, i) AS a, substring(word, i + 2) AS b FROM w, range(0, length(word)) r(i)),
pairs AS (
  SELECT DISTINCT x.word AS word, y.word AS near, y.n AS m FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN w y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM holes x JOIN w y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n,
    CASE WHEN b.m >= 5 * w.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.m = b.m) END AS form
  FROM w LEFT JOIN best b ON b.word = w.word),
way AS (SELECT word, form AS goal, 1 AS k FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN formed f ON f.word = way.goal WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(goal, k) AS root FROM way GROUP BY word)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM formed f LEFT JOIN ends e ON e.word = f.word
"""
