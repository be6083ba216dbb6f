import datetime as dt
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from matchloom.functions.normal import normal_cdf, ordinal
from matchloom.sources import files

SF = "/root/testdata/sf0.001"
NAMES = [
    "SC1_match_scan", "SC2_event_scan", "SC3_lineup_scan", "SC6_season_files", "SC13_upsert", "SC14_carry_forward", "FP5_price_fallback", "FP6_season_split", "FP14_rating_snapshots",
    "ER6_new_ids", "EV9_calibration_by_phase", "EV12_decaying_blend", "EV17_worst", "ML9_meta_holdout", "PR8_oversample",
]


def rounded(rows):
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    return sorted(str([round(float(v), 5) + 0.0 if number(v) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert rounded(map(tuple, got.select(*cols).collect())) == rounded(want)


def test_arg_extremes_of_equal_prices(spark, tmp_path):
    rows = [(k, k % 3, None if k > 30 else float(k % 2)) for k in range(1, 32)]  # a price twice and more, one without
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE)")
    con.executemany("INSERT INTO orders VALUES (?, ?, ?)", rows)
    want = con.sql(f"SELECT o_custkey, cheapest, dearest FROM ({__spark_entry__.oracle_sql()['AG20_arg_extremes']})").fetchall()
    got = __spark_entry__.queries()["AG20_arg_extremes"](spark, str(tmp_path)).select("o_custkey", "cheapest", "dearest").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_arg_extremes_of_missing_keys(spark, tmp_path):
    rows = [(None, 1, 1.0), (5, 1, 2.0), (None, 1, 3.0), (None, 2, 1.0), (7, 3, float("nan")), (8, 3, 1.0), (9, 4, None), (-(2**63), 5, 1.0), (6, None, 1.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE)")
    con.executemany("INSERT INTO orders VALUES (?, ?, ?)", rows)
    want = con.sql(f"SELECT o_custkey, cheapest, dearest FROM ({__spark_entry__.oracle_sql()['AG20_arg_extremes']})").fetchall()
    got = __spark_entry__.queries()["AG20_arg_extremes"](spark, str(tmp_path)).select("o_custkey", "cheapest", "dearest").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_calibrated_probabilities_sum_to_one(spark):
    rows = __spark_entry__.queries()["ML7_calibrated"](spark, SF).collect()
    assert rows and all(abs(r.p_h + r.p_d + r.p_a - 1) < 1e-5 and min(r.p_h, r.p_d, r.p_a) > 0 for r in rows)


def test_manifest_has_each_file_once(spark):
    rows = __spark_entry__.queries()["SC11_manifest"](spark, SF).collect()
    assert rows and len({r.file for r in rows}) == len(rows) and all(len(r.digest) == 64 and r.bytes > 0 for r in rows)


def test_scans_take_missing_parts(spark):
    raw = spark.createDataFrame([(1, dt.date(2020, 1, 1), None, (7,), None, 1, None)], files.MATCH)
    assert tuple(files.flatten_matches(raw).first()) == (1, dt.date(2020, 1, 1), None, None, 7, None, 1, None)
    events = spark.createDataFrame([(1, 1, None, None, None, None, ("Red",)), (1, 2, ("Pass",), (3,), [4.0], ("Yellow",), ("Red",))], files.EVENT)
    assert [tuple(r)[2:] for r in files.flatten_events(events).orderBy("event_id").collect()] == [(None, None, None, None, "Red"), ("Pass", 3, 4.0, None, "Yellow")]
    teams = [("a", [(9, [1, 1], [("00:00", 1)]), (8, [], []), (7, [], [("00:00", 2)])])]
    rows = files.flatten_lineups(spark.createDataFrame([(1, teams), (2, [])], files.LINEUP)).collect()
    assert sorted((r.player_id, r.started, r.n_cards) for r in rows) == [(7, False, 0), (8, False, 0), (9, True, 2)]


def test_upsert_replaces_whole_keys_and_carry_forward_marks(spark):
    old = spark.createDataFrame([("m", 1), ("m", 2), ("k", 3)], "model string, v int")
    new = spark.createDataFrame([("m", 9)], "model string, v int")
    assert sorted(map(tuple, files.upsert(old, new, ["model"]).collect())) == [("k", 3), ("m", 9)]
    assert sorted(map(tuple, files.carry_forward(old, new, ["model"]).collect())) == [("k", 3, True), ("m", 9, False)]
    assert files.upsert(old, new.where("false"), ["model"]).count() == 3


def test_season_of_path(spark):
    df = spark.createDataFrame([("x/code=9596/a.csv",), ("x/code=9900/a.csv",), ("x/code=1617/a.csv",)], "p string")
    assert [r[0] for r in df.select(files.season_of_path(F.col("p"))).collect()] == ["1995/1996", "1999/2000", "2016/2017"]


def test_normal_link(spark):
    z = spark.createDataFrame([(0.0,), (1.96,), (-1.96,)], "z double").select(normal_cdf(F.col("z"))).collect()
    assert [round(r[0], 3) for r in z] == [0.5, 0.975, 0.025]
    h, d, a = spark.range(1).select(*ordinal(F.lit(0.0), F.lit(0.5), F.lit(1.0))).first()
    assert abs(h - a) < 1e-6 and abs(h + d + a - 1) < 1e-9 and abs(d - 0.3829) < 1e-3


def test_entry_imports_without_a_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=os.path.dirname(__spark_entry__.__file__), capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
