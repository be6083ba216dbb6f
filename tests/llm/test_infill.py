"""Fill-in-middle against plain slicing, on other units, and on rows that need care."""

import hashlib

import regex
from pyspark.sql import functions as F

from matchloom.llm import infill
from matchloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plainly(key, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_query_equals_slicing(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op13_infill"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        n, form, p, m, out = plainly(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, p, m, hashlib.sha256(out.encode()).hexdigest())
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_rows_that_need_care(spark):
    rows = [(i, t, 1, "x") for i in range(40) for t in ("a\nb\r c", "", None, "𝄞é<", "has <S> in it", "<" * 9, "same", "same")]
    rows += [(None, "no id", 2, "x"), (None, None, 2, "x"), (5, "é𝄞 " * 500_000, 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, output string")
    out = infill.fill_in_middle(df, "doc_id", "text")
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, [(r.doc_id, *r[1:6]) for r in got])) == sorted(map(repr, [(i, *plainly(i, t)) for i, t, *_ in rows]))
    assert sorted(map(repr, [(r.doc_id, r.back) for r in got])) == sorted(map(repr, [(i, t or "") for i, t, *_ in rows]))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.limit(0), "doc_id", "text").count() == 0


def test_pieces_and_units():
    one, word = regex.compile(f"({infill.CODE_POINT})*"), regex.compile(r"(\s*+\S++\s*+)*")
    old, infill.PIECE = infill.PIECE, 7
    try:
        for n in (0, 1, 6, 7, 8, 21, 50):
            assert infill.cuts("é" * n, one, True, 40, 9) == (n, *sorted((40 % (n + 1), 9 % (n + 1))))
    finally:
        infill.PIECE = old
    assert infill.cuts("one  two three ", word, False, 1, 6) == (3, 5, 9)
