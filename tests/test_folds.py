"""Ratings as a table function, over pools and as a stream give what one plain fold gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import ratings
from matchloom.operators.components import components
from matchloom.plans.folds import season_by_season
from matchloom.streaming import live

KINDS = "match_id long, match_date date, season int, league int, home_team_id int, away_team_id int, home_score int, away_score int"


def league_of_pools(seed=4, pools=6):
    """Matches of two leagues whose teams play within pools only; newcomers come in later seasons."""
    draw, rows = random.Random(seed), []
    for i in range(500):
        season, pool = 2001 + i // 100, draw.randrange(pools)
        a, b = draw.sample(range(3 if season == 2001 else 3 + season % 3), 2)
        rows.append((i, dt.date(season, 1, 1) + dt.timedelta(days=i % 100), season, pool % 2, 100 * pool + a, 100 * pool + b, draw.randrange(5), draw.randrange(4)))
    draw.shuffle(rows)
    return rows


def plainly(rows, **elo):
    out = {}
    for league in {r[3] for r in rows}:
        fold = ratings.League(ratings.ELO | elo)
        for m in sorted((r for r in rows if r[3] == league), key=lambda r: (r[1], r[0])):
            out[m[0]] = tuple(round(x, 3) for x in fold.play(m[2], *m[4:]))
    return out


def of(df):
    return {r.match_id: tuple(round(r[c], 3) for c in ratings.NUMBERS) for r in df.collect()}


def close(a, b):
    return a.keys() == b.keys() and all(abs(x - y) <= 0.0011 for k in a for x, y in zip(a[k], b[k]))


def test_table_function_and_pools_equal_the_plain_fold(spark):
    rows = league_of_pools()
    df = spark.createDataFrame(rows, KINDS).withColumn("more", F.lit("x")).repartition(5)
    want = plainly(rows)
    assert close(of(ratings.rate(df)), want) and close(of(ratings.rate_pools(df)), want)
    other = {"k": 35.0, "carry": 0.5, "newcomer": 20.0}
    assert close(of(ratings.rate_pools(df, other)), plainly(rows, **other))
    assert ratings.rate(df.limit(0)).count() == ratings.rate_pools(df.limit(0)).count() == 0


def test_pools_ask_for_seasons_apart(spark):
    day = dt.date(2001, 1, 1)
    rows = [(1, day, 2001, 1, 1, 2, 0, 0), (2, day + dt.timedelta(days=9), 2002, 1, 1, 2, 0, 0), (3, day + dt.timedelta(days=20), 2001, 1, 1, 2, 0, 0)]
    with pytest.raises(ValueError, match="overlap"):
        ratings.rate_pools(spark.createDataFrame(rows, KINDS))


def test_components_of_paths_stars_and_loops(spark):
    draw, parent = random.Random(2), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    edges = [(i, i + 1) for i in range(40, 90)] + [(100, i) for i in range(101, 120)] + [(5, 5), (7, None)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)]
    for a, b in edges:
        if b is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_stream_goes_on_from_its_checkpoint_and_asks_for_order(spark, tmp_path):
    rows = league_of_pools(9)
    days = sorted({r[1] for r in rows})
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, KINDS)
    stream = lambda: ratings.rate_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))
    for low, high in zip([days[0], days[120], days[300]], [days[120], days[300], dt.date(2100, 1, 1)]):
        df.where((F.col("match_date") >= F.lit(low)) & (F.col("match_date") < F.lit(high))).coalesce(1).write.mode("append").parquet(path)
        rated = live.drained(stream(), "append", out)  # a query of its own each time
    assert close(of(rated), plainly(rows))
    df.limit(1).withColumn("match_id", F.lit(9_999).cast("long")).coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(Exception, match="arrives after"):
        live.drained(stream(), "append", out)


def test_seasons_of_several_files_stream_in_order(spark):
    rows = league_of_pools(7)
    df = spark.createDataFrame(rows, KINDS).repartition(5)  # a season's matches are spread over files in no order
    assert close(of(season_by_season(df)), plainly(rows))
    assert season_by_season(df.limit(0)).count() == 0
