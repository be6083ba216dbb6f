import os

import duckdb
import pytest
from pyspark.sql import functions as F

from matchloom.operators.columns import reindex
from matchloom.plans import shapes
from matchloom.plans.registry import QUERIES, SQL
from test_plans import SF, rounded

NAMES = [n for n, f in QUERIES.items() if f.__module__ == shapes.__name__ and n in SQL]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert want and rounded(map(tuple, got.select(*cols).collect())) == rounded(want)


def test_reindex_fills_missing_columns(spark):
    out = reindex(spark.range(2).withColumn("gone", F.lit(1)), {"name": "string", "id": "int"})
    assert out.dtypes == [("name", "string"), ("id", "int")] and {r.name for r in out.collect()} == {None}


def test_ratings_favour_home_teams(spark):
    (r,) = QUERIES["RT4_rating_sanity"](spark, SF).collect()
    assert r.n == 211 and 0 < r.home_wins < 1 and r.favoured > 0.5


def test_a_snapshot_with_a_later_event_fails(spark, monkeypatch):
    """The prefix expectation notices snapshots that reach one minute too far."""
    honest = shapes.temporal.prefix_snapshots
    monkeypatch.setattr(shapes.temporal, "prefix_snapshots", lambda e, *a: honest(e.withColumn("minute", F.col("minute") - 1), *a))
    assert QUERIES["ES5_prefix_holds"](spark, SF).where("NOT holds").count() > 0
