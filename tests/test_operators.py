"""Hand-computed windows, contracts, ratings, and a sample of queries against SQL."""

import datetime as dt
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from matchloom.operators import contracts, ratings, temporal
from matchloom.plans.forecasting import prematch
from matchloom.sources import views

SF = "/root/testdata/sf0.001"


def matches(spark, last=(1, 0)):
    scores = [(2, 1), (0, 0), (1, 3), (3, 3), (5, 0), (1, 1), last]
    days = [0, 3, 10, 17, 31, 33, 47]
    rows = [(100 + i, dt.date(2019, 3, 2) + dt.timedelta(days=d), 2015, 1, 1, 2, h, a) for i, (d, (h, a)) in enumerate(zip(days, scores))]
    return spark.createDataFrame(rows, "match_id long, match_date date, season int, league int, home_team_id int, away_team_id int, home_score int, away_score int")


def test_prior_windows(spark):
    rows = {r.match_id: r for r in prematch(matches(spark)).collect()}
    assert rows[100].home_form_points is None and rows[100].home_rest_days is None and rows[100].home_played_prior == 0
    assert rows[103].home_form_gf == pytest.approx(1.0)
    assert rows[106].home_form_gf == pytest.approx(2.0)
    assert [rows[100 + i].home_rest_days for i in range(1, 7)] == [3, 7, 7, 14, 2, 14]
    assert rows[106].diff_form_points == pytest.approx(rows[106].home_form_points - rows[106].away_form_points)


def test_own_score_leaves_own_features(spark):
    a, b = (prematch(matches(spark, last)) for last in ((1, 0), (9, 0)))
    assert a.exceptAll(b).isEmpty()


def test_asof_is_strict_and_keeps_misses(spark):
    left = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 3, 1.0), (1, 5, 2.0)], "k int, s int, v double")
    got = {(r.k, r.t): r.v for r in temporal.asof_join(left, right, "k", "t", "s", "v").collect()}
    assert got == {(1, 5): 1.0, (1, 6): 2.0, (2, 5): None}


def test_elo_is_zero_sum_and_first_match_starts_level(spark):
    out = ratings.rate(matches(spark)).orderBy("match_id").collect()
    assert (out[0].elo_home_pre, out[0].elo_away_pre, out[0].pi_expected_gd) == (1500.0, 1500.0, 0.0)
    assert all(math.isclose(r.elo_home_pre + r.elo_away_pre, 3000, abs_tol=1e-3) for r in out)


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError):
        contracts.keyed_join(df, df, ["k"], "inner", "one_to_one")
    with pytest.raises(ValueError):
        contracts.expect(df, {"v is 2": F.col("v") == 2}, strict=True)
    assert contracts.expect(df, {"v is 2": F.col("v") == 2}).first().violations == 1


@pytest.mark.parametrize("name", ["FP7_prematch_features", "JN8_asof", "ES1_snapshots", "ES10_stream_prefix", "ES11_stream_windows", "ER2_resolve", "EV1_scores", "AG4_possession"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    clean = lambda rows: sorted(str([round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows)
    assert clean(map(tuple, got.select(*cols).collect())) == clean(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name,times", [("JN8_asof", 2), ("FP11_squads", 4), ("FP10_lineup_strength", 2), ("EX7_strictly_before", 2)])
def test_as_of_joins_have_more_tasks_for_more_rows(spark, monkeypatch, name, times):
    """A task sorts a bounded number of rows, whatever the setting for shuffles, and the rows are those of the SQL."""
    tasks, asof = [], temporal.asof_join

    def seen(*args):
        out = asof(*args)
        tasks.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(views, "ROWS_A_TASK", 1_000)
    monkeypatch.setattr(temporal, "asof_join", seen)
    got = __spark_entry__.queries()[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(str([float(v) if isinstance(v, (int, float)) else v for v in r]) for r in rows)
    assert plain(map(tuple, got.collect())) == plain(want)
    assert tasks[0] >= times * spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1_000 > 4
