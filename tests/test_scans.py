"""The scan in file order: a clean file equals the aggregation, matches are carried over, one that comes again is reported."""

import pytest
from pyspark.sql import functions as F

from matchloom.streaming import live, scans

KINDS = "pos long, match_id long, type string, value double"


def rows_of(runs):
    """Rows (pos, match_id, type, value) of runs (match_id, number of rows)."""
    out = []
    for match, n in runs:
        out += [(len(out) + i, match, "purchase" if i % 3 == 0 else "view", 1.0 + i) for i in range(n)]
    return out


def scanned(spark, rows, slices, strict=True):
    path, df = scans.in_slices(spark.createDataFrame(rows, KINDS), slices)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return live.drained(scans.scan_stream(stream, strict), "append")


def test_clean_file_in_slices(spark):
    rows = rows_of([(7, 4), (3, 9), (5, 1), (4, 6)])  # slices cut matches 3 and 4
    got, want = scanned(spark, rows, 3), scans.runs(spark.createDataFrame(rows, KINDS))
    assert got.count() == 4 and got.exceptAll(want.select(got.columns)).isEmpty() and got.where("NOT contiguous").isEmpty()


def test_interleaved_matches_are_reported(spark):
    rows = rows_of([(1, 5), (2, 4), (1, 3), (3, 2)])
    with pytest.raises(Exception, match="match 1 is not contiguous"):
        scanned(spark, rows, 3)  # match 1 has ended before it comes again
    with pytest.raises(Exception, match="match 1 is not contiguous"):
        scanned(spark, rows, 1)  # both runs in one batch
    got = scanned(spark, rows, 4, strict=False).groupBy("match_id").agg(F.max_by("contiguous", "events").alias("c"), F.max("events").alias("n")).collect()
    assert {r.match_id: (r.c, r.n) for r in got} == {1: (False, 8), 2: (True, 4), 3: (True, 2)}
    assert {r.match_id: r.contiguous for r in scans.runs(spark.createDataFrame(rows, KINDS)).collect()} == {1: False, 2: True, 3: True}


def test_places_over_files(spark, tmp_path):
    df = spark.createDataFrame(rows_of([(m, 3) for m in range(20)]), KINDS).withColumnRenamed("pos", "was")
    df.repartitionByRange(4, "was").sortWithinPartitions("was").write.parquet(f"{tmp_path}/x")
    assert [r.pos for r in scans.positions(spark.read.parquet(f"{tmp_path}/x")).orderBy("was").collect()] == list(range(60))
