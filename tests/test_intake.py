"""Season files in several encodings."""

import codecs

import pytest

from matchloom.plans.intake import batches_in
from matchloom.sources import seasons, tables

FILES = {
    "a/bom.csv": codecs.BOM_UTF8 + "Date,Team,Goals\n1,Málaga,2\n2,Çorum,x\n".encode(),
    "a/latin.csv": "Team,Date,Goals\r\nMálaga,1,2\r\nMálaga,1,2,9\r\n\r\nBurgos,3\r\n".encode("latin-1"),
    "b/plain.csv": 'Date,Team\n4,"Köln, 1. FC\nSüd"\n5,\n'.encode(),
    "b/late.csv": codecs.BOM_UTF8 + b"Date,Team,Goals\n6,M\xe9rida,0\n",
    "b/empty.csv": b"",
    "b/not.txt": b"Date\n9\n",
}


def test_encodings_columns_and_rejects(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows, rejects = seasons.read(spark, str(tmp_path), {"Date": "int", "Team": "string", "Goals": "int"})
    got = {(r.file.rsplit("/", 1)[1], r.encoding, r.line, r.Date, r.Team, r.Goals) for r in rows.collect()}
    assert got == {
        ("bom.csv", "utf-8-sig", 2, 1, "Málaga", 2), ("latin.csv", "latin-1", 2, 1, "Málaga", 2), ("latin.csv", "latin-1", 5, 3, "Burgos", None),
        ("plain.csv", "utf-8", 2, 4, "Köln, 1. FC\nSüd", None), ("plain.csv", "utf-8", 4, 5, None, None), ("late.csv", "latin-1", 2, 6, "Mérida", 0),
    }
    assert {(r.file.rsplit("/", 1)[1], r.line, r.reason, r.text) for r in rejects.collect()} == {("bom.csv", 3, "Goals is no int", "2,Çorum,x"), ("latin.csv", 3, "4 fields, not 3", "Málaga,1,2,9")}


def rows_in(spark, path, version=None):
    return sorted(map(tuple, tables.current(spark, path, version).select("k", "v", "x").collect()), key=repr)


def test_a_run_shows_up_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    of = lambda rows: spark.createDataFrame(rows, "k string, v int, x string")
    with pytest.raises(ValueError, match="no run"):
        tables.current(spark, path)
    tables.replace(of([("a", 1, "x"), ("01", 5, "x"), ("1", 6, "x"), ("b", 2, "x"), (None, 3, "x")]), path, ["k"], "one")
    first = rows_in(spark, path)
    tables.stage(of([("b", 9, "y"), ("c", 4, "y")]), path, ["k"], "two", 2)  # the run dies here
    assert rows_in(spark, path) == first and tables.log(spark, path) == {1: "one"}
    tables.replace(of([("b", 9, "y"), ("c", 4, "y"), ("c", 4, "y")]), path, ["k"], "two")  # and is tried again
    want = sorted([("a", 1, "x"), ("01", 5, "x"), ("1", 6, "x"), (None, 3, "x"), ("b", 9, "y"), ("c", 4, "y"), ("c", 4, "y")], key=repr)
    assert rows_in(spark, path) == want
    tables.replace(of([("b", 0, "z")]), path, ["k"], "two")  # a run that is done does nothing
    assert rows_in(spark, path) == want and rows_in(spark, path, 1) == first
    tables.stage(of([("a", 7, "w")]), path, ["k"], "three", 3)
    tables.replace(of([(None, 8, "w")]), path, ["k"], "other")
    with pytest.raises(RuntimeError, match="stage three again"):
        tables.commit(spark, path, "three", 3)
    assert ("a", 1, "x") in rows_in(spark, path) and (None, 8, "w") in rows_in(spark, path) and (None, 3, "x") not in rows_in(spark, path)
    tables.replace(of([]), path, ["k"], "none")
    assert len(rows_in(spark, path)) == len(want)


def test_added_columns_and_a_batch_that_is_run_again(spark, tmp_path):
    path, source = str(tmp_path / "t"), str(tmp_path / "s")
    for i, rows in enumerate(([("a", 1), ("b", 2)], [("b", 5)])):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).parquet(source)
    tables.replace_from_stream(stream(), path, ["k"], str(tmp_path / "c1"))
    tables.replace_from_stream(stream(), path, ["k"], str(tmp_path / "c2"))  # its checkpoint is lost, so all batches come again
    assert len(tables.log(spark, path)) == 2
    tables.replace(spark.createDataFrame([("c", 1, "new")], "k string, v int, note string"), path, ["k"], "later")
    assert {tuple(r) for r in tables.current(spark, path).select("k", "v", "note").collect()} == {("a", 1, None), ("b", 5, None), ("c", 1, "new")}


def test_a_version_of_many_files_is_one_batch(spark, tmp_path):
    path, kinds = str(tmp_path / "t"), "match_id long, season int, league int, goals long"
    old = spark.createDataFrame([(i, 1999 + i % 2, i % 3, 1) for i in range(60)], kinds).repartition(5)
    new = spark.createDataFrame([(i, 1999, i % 2, 2) for i in range(100, 140)], kinds).repartition(3)
    batches_in((old, new), path)
    assert len(tables.log(spark, path)) == 2 and len(list((tmp_path / "t_source").glob("*.parquet"))) > 2
    got = sorted(map(tuple, tables.current(spark, path).select("match_id", "season", "league", "goals").collect()))
    assert got == sorted([tuple(r) for r in old.collect() if not (r.season == 1999 and r.league < 2)] + [tuple(r) for r in new.collect()])
