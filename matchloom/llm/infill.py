"""Fill-in-middle: texts cut in three by their units and put in another order, with the middle last."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import table

#: What opens the prefix, the suffix and the middle of an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, as many are cut, and of 100 cut ones as many have the suffix first.
CUT_SHARE, SPM_SHARE = 90, 20
#: One code point, the default unit.
CODE_POINT = "(?s:.)"
#: Code points matched at a time where the unit is a code point: a match keeps about 60 bytes for each.
PIECE = 1 << 20


def cuts(text: str, unit: regex.Pattern, one: bool, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of units, and the offsets at which prefix and middle end.

    unit is the pattern (unit)*, whose one full match retains the end of every repetition.
    """
    if one and len(text) > PIECE:  # any offset is the end of a unit, so pieces can be matched by themselves
        ends = [len(unit.fullmatch(text, at, min(at + PIECE, len(text))).ends(1)) for at in range(0, len(text), PIECE)]
        n = sum(ends)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        return n, a, b
    match = unit.fullmatch(text)
    if match is None:
        raise ValueError(f"the unit {unit.pattern} does not cover the text")
    ends = match.ends(1)
    n = len(ends)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[a - 1] if a else 0, ends[b - 1] if b else 0


def arrange(text: str, key: str, unit: regex.Pattern, one: bool) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n, a, b = cuts(text, unit, one, h1, h2)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= CUT_SHARE:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_SHARE:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(df: DataFrame, id_col: str, text_col: str, unit: str = CODE_POINT) -> DataFrame:
    """One row for each row: id, n, form, prefix_chars, middle_chars (code points; null if plain), output.

    A text is a run of units, matched left to right; it is an error if they do not cover it. Cuts, form and order come
    from a hash of the id alone, so rows of one id and text come out alike and a run can be repeated. A null text counts
    as empty, a null id as one without digits; empty texts, and those that hold a mark already, stay plain. Rows may
    repeat; an empty table gives no rows; other columns are dropped. Nothing is shuffled. A task keeps one text and the
    ends of its units, or of one piece of a very long text if units are code points.
    """
    one = unit == CODE_POINT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(f"({unit})*")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [arrange(t.as_py() or "", k.as_py() or "", pattern, one) for k, t in zip(part.column(1), part.column(2))]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    inner = df.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    said = inner.drop("key", "text").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return inner.mapInArrow(run, said).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of: its parts lie between marks, which no cut text holds."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), "doc_id", "text")
    back = restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


_H = ", ".join(f"('0x' || substr(d, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, {_H} FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {CUT_SHARE} THEN 'plain'
    WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
