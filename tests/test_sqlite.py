"""SQLite files: round trips, parts, filters in the plan and in the files' SQL, writes that appear as a whole."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from matchloom.sources import sqlite

ROWS = [(i, i % 7 if i % 5 else None, ["Ää", "b_c", 'q"%', "", None][i % 5], dt.date(2000, 1, 1) + dt.timedelta(days=i), i / 3 if i % 4 else None, i % 2 == 0) for i in range(1_000)]
KINDS = "id long, k int, name string, day date, x double, flag boolean"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sqlite") / "t")
    sqlite.write(spark.createDataFrame(ROWS, KINDS).repartition(3), path, "A table")
    return path


def test_round_trip_in_parts(spark, store):
    df = sqlite.read(spark, store, "A table", part_rows=100)
    assert df.rdd.getNumPartitions() >= 10 and df.dtypes == spark.createDataFrame(ROWS, KINDS).dtypes
    assert sorted(map(tuple, df.collect())) == ROWS
    assert len(sqlite.files_of(store)) == 3 and sqlite.read(spark, store, "A table", ["name", "id"]).columns == ["name", "id"]


@pytest.mark.parametrize("where", ["id >= 990", "k = 3", "k <=> null", "k <> 3", "k IN (1, 2)", "name LIKE 'b_c%'", "name = 'Ää' AND x > 100", "name IS NULL", "day < date'2000-02-01'", "flag", "NOT (k > 2)", "name LIKE '%\"%'", "x / 2 > 100", "k = 1 OR id < 5"])
def test_filters_mean_what_they_mean_in_spark(spark, store, where):
    want = spark.createDataFrame(ROWS, KINDS).where(where)
    got = sqlite.read(spark, store, "A table").where(where)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_plan_shows_the_pushed_filter_and_columns(spark, store, capsys):
    sqlite.read(spark, store, "A table", ["id", "k"]).where("k = 3 AND id > 900 AND id % 2 = 0").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(k), IsNotNull(id), EqualTo(k,3), GreaterThan(id,900)]" in plan and "ReadSchema: struct<id:bigint,k:int>" in plan
    said = sqlite.Reader({"path": store, "table": "A table"}, sqlite.read(spark, store, "A table", ["id"]).schema)
    assert list(said.pushFilters([sqlite.ds.EqualTo(("k",), 3), sqlite.ds.StringEndsWith(("name",), "c")])) == [sqlite.ds.StringEndsWith(("name",), "c")]
    assert said.sql() == 'SELECT "id" FROM "A table" WHERE rowid >= ? AND rowid < ? AND ("k" = ?)' and said.values == [3]


def test_a_write_appears_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "w")
    sqlite.write(spark.range(5), path, "t")
    with pytest.raises(Exception, match="boom"):
        sqlite.write(spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("id")).alias("id")), path, "t")
    assert sorted(r.id for r in sqlite.read(spark, path, "t").collect()) == [0, 1, 2, 3, 4]
    sqlite.write(spark.range(3), path, "t", mode="append")
    assert sqlite.read(spark, path, "t").count() == 8
    sqlite.write(spark.range(2).where("id > 5"), path, "t")
    assert sqlite.read(spark, path, "t").count() == 0 and all(os.path.getsize(f) for f in sqlite.files_of(path))
    with pytest.raises(ValueError, match="no type"):
        sqlite.write(spark.range(1).select(F.array("id").alias("a")), path, "t")
    with pytest.raises(ValueError, match="mounted"):
        sqlite.local("hdfs://x/y")
