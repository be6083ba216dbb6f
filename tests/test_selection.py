"""Rules over columns and names, balancing geometry, shrunk trees, grids; a sample of queries against SQL."""

import datetime as dt
import math
import os

import duckdb
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import __spark_entry__
from matchloom.functions.text import token_similarity
from matchloom.operators import balancing, ratings, shrinkage
from matchloom.operators.columns import resolve_groups
from matchloom.operators.resolve import resolve
from matchloom.operators.windows import running_max
from matchloom.plans.balancing import training
from matchloom.plans.forecasting import prematch
from matchloom.plans.selection import SPACE, candidates, counts, gathered, losses, scaled
from matchloom.sources.views import fixtures

SF = "/root/testdata/sf0.001"
NAMES = ["FP1_label_store", "FP2_clean_store", "FP9_stat_form", "FP15_audit", "PF9_column_groups", "ER2_resolve", "ER5_short_names", "EV19_arm_summary", "PR9_danger", "PR10_snap_back", "PR11_geometric", "ST2_bootstrap"]


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
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert rounded(map(tuple, got.select(*cols).collect())) == rounded(want)


def test_a_column_is_claimed_once():
    assert resolve_groups(["venue_form", "form", "x"], [("venue", "venue"), ("form", "form"), ("none", "zzz")]) == {"venue": ["venue_form"], "form": ["form"]}
    assert resolve_groups([], [("a", "a")]) == {}


def test_candidates_agree_and_differ():
    a = candidates(SPACE, 12, 1)
    assert a == candidates(SPACE, 12, 1) != candidates(SPACE, 12, 2) and len({str(c) for c in a}) == 12
    assert len(candidates(SPACE, 1000, 1)) == math.prod(map(len, SPACE.values()))


def test_names_meet_by_edits_beginnings_and_not_otherwise(spark):
    pool = spark.createDataFrame([("arsenal",), ("real madrid",), ("ajax",)], "name string")
    names = spark.createDataFrame([("Arsenal",), ("brsenal",), ("arsen",), ("real sociedad",), ("rael madrid",), ("qqq",), ("ajxx",), (None,), ("",)], "source_name string")
    got = {r.source_name: (r.canonical, r.method) for r in resolve(names, pool, token_similarity).collect()}
    assert got["Arsenal"] == ("arsenal", "exact") and got["brsenal"] == ("arsenal", "fuzzy") and got["arsen"] == ("arsenal", "fuzzy")
    assert got["rael madrid"] == ("real madrid", "fuzzy") and got["real sociedad"] == ("real madrid", "fuzzy")
    assert got["qqq"] == (None, "below_threshold") and got[None] == (None, "below_threshold") and got["ajxx"] == ("ajax", "fuzzy")
    short = {r.source_name: r.method for r in resolve(names, pool, token_similarity, short=8).collect()}
    assert short["brsenal"] == "below_threshold" and short["Arsenal"] == "exact" and short["rael madrid"] == "fuzzy"


def test_disc_points_stay_inside_and_face_the_rim(spark):
    df = spark.range(500).select((F.col("id") % 7 * 1.0).alias("x"), balancing.uniform("a", "id").alias("a"), F.sqrt(balancing.uniform("r", "id")).alias("r"))
    at = lambda t, f: df.select("x", *[c.alias(n) for c, n in zip(balancing.in_disc((F.col("x"), F.lit(1.0)), (F.lit(3.0), F.lit(2.0)), F.col("a"), F.col("r"), t, f), ("px", "py", "size"))]).collect()
    for r in at(1.0, 0.0):
        dx, dy = r.px - r.x, r.py - 1
        assert math.hypot(dx, dy) <= r.size + 1e-9 and dx * (3 - r.x) + dy * 1.0 >= -1e-9
    for r in at(1.0, 1.0):  # all on the line
        assert abs((r.px - r.x) * 1.0 - (r.py - 1) * (3 - r.x)) < 1e-9
    same = spark.range(1).select(*balancing.in_disc((F.lit(1.0), F.lit(2.0)), (F.lit(1.0), F.lit(2.0)), F.lit(0.3), F.lit(0.9), 1.0, 0.5)).first()
    assert tuple(same) == (1.0, 2.0, 0.0)


def test_mode_and_snap(spark):
    df = spark.createDataFrame([([3, 1, 1, 3],), ([2],), ([],)], "v array<int>").select(balancing.mode(F.col("v")).alias("m")).collect()
    assert [r.m for r in df] == [1, 2, None]
    rows = spark.createDataFrame([(1, 3, 0.2), (1, 3, 0.8), (3, 1, 0.5), (2, 2, 0.9)], "a int, b int, u double")
    assert [r[0] for r in rows.select(balancing.snapped(F.col("a"), F.col("b"), F.col("u"), [1, 2, 3])).collect()] == [1, 3, 1, 2]


def test_shrinkage_follows_the_path(spark):
    # root (8 rows) -> 1 (leaf), 2 (4 rows) -> 3, 4 (leaves); a second tree of one leaf
    nodes = spark.createDataFrame(
        [(0, 0, 1, 2, 8, [0.5, 0.25, 0.25]), (0, 1, -1, -1, 4, [1.0, 0.0, 0.0]), (0, 2, 3, 4, 4, [0.0, 0.5, 0.5]), (0, 3, -1, -1, 2, [0.0, 1.0, 0.0]), (0, 4, -1, -1, 2, [0.0, 0.0, 1.0]), (1, 0, -1, -1, 8, [0.5, 0.25, 0.25])],
        "tree int, id int, left int, right int, n long, mean array<double>",
    )
    got = {(r.tree, r.leaf): r.shrunk for r in shrinkage.shrink(nodes, [0.0, 4.0, 1e12], 3).collect()}
    assert set(got) == {(0, 0), (0, 1), (0, 2), (1, 0)}
    assert got[0, 1][0] == pytest.approx([0.0, 1.0, 0.0]) and got[0, 1][2] == pytest.approx([0.5, 0.25, 0.25], abs=1e-9)
    step = lambda root, mid, leaf: root + (mid - root) / (1 + 4 / 8) + (leaf - mid) / (1 + 4 / 4)
    assert got[0, 1][1] == pytest.approx([step(0.5, 0, 0), step(0.25, 0.5, 1), step(0.25, 0.5, 0)])
    assert got[1, 0][1] == pytest.approx([0.5, 0.25, 0.25])


def test_unshrunk_forest_is_the_model(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = spark.range(300).select("id", (F.col("id") % 3).cast("double").alias("label"), (F.col("id") % 3 + F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=3).setLeafCol("leaves").fit(df)
    leaves = shrinkage.shrink(shrinkage.nodes_of(spark, model, str(tmp_path / "m")), [0.0], 4)
    scored = model.transform(df).select("id", vector_to_array("leaves").alias("leaf"), vector_to_array("probability").alias("want"))
    rows = shrinkage.score(scored, "id", "leaf", leaves, ["want"]).collect()
    assert len(rows) == 300 and all(r.p == pytest.approx(list(r.want)) for r in rows)


def test_a_grid_of_ratings_holds_the_plain_ones(spark):
    f = fixtures(spark, SF)
    both = ratings.rate_all(f, [{}, {"k": 40.0}])
    assert both.where("candidate = 0").drop("candidate").exceptAll(ratings.rate(f)).isEmpty()
    assert not both.where("candidate = 1").drop("candidate").exceptAll(ratings.rate(f)).isEmpty()
    assert ratings.rate(f, {"k": 40.0}).exceptAll(both.where("candidate = 1").drop("candidate")).isEmpty()


def test_learners_give_sound_rows(spark):
    q = __spark_entry__.queries()
    rows = q["ML5_shrunk_forest"](spark, SF).collect()
    assert rows and all(abs(r.p_h + r.p_d + r.p_a - 1) < 1e-5 for r in rows)
    assert all(-5 <= r.ridge <= 5 for r in q["ML6_kernel_ridge"](spark, SF).collect())
    arms = {r.arm: r for r in q["ML13_ablation"](spark, SF).collect()}
    assert arms["full"].change == 0 and {"balanced", "without form", "without ratings", "without venue", "half of the matches"} < set(arms)


def test_windows_of_a_team_at_both_venues(spark):
    scores = [(10, 20, 2, 0), (20, 10, 1, 1), (10, 30, 0, 0), (30, 10, 2, 1), (10, 20, 3, 1)]
    rows = [(i + 1, dt.date(2020, 1, 4) + dt.timedelta(days=7 * i), 2020, 1, *s) for i, s in enumerate(scores)]
    f = spark.createDataFrame(rows, "match_id long, match_date date, season int, league int, home_team_id int, away_team_id int, home_score int, away_score int")
    got = {r.match_id: r for r in prematch(f).collect()}
    last = got[5]
    assert last.home_form_points == pytest.approx((3 + 1 + 1 + 0) / 4) and last.home_rest_days == 7
    assert last.home_venue_points == pytest.approx((3 + 1) / 2) and last.home_h2h_points == pytest.approx((3 + 1) / 2)
    assert [got[1].home_played_prior, got[2].away_played_prior, got[3].home_played_prior, got[4].away_played_prior, last.home_played_prior] == [0, 1, 2, 3, 4]


def test_a_clock_that_falls_back_is_held(spark):
    rows = spark.createDataFrame(list(zip([1] * 8, range(8), [0, 5, 8, 10, 10, 0, 20, 40])), "match_id int, idx int, minute int")
    eff = rows.select("idx", running_max("minute", ["match_id"], ["idx"]).alias("e")).orderBy("idx")
    assert [r.e for r in eff.collect()] == [0, 5, 8, 10, 10, 10, 20, 40]


def test_synthetic_rows_fill_their_class_and_stay_near(spark):
    rows = {(r.season, r.league, r.y): r for r in training(spark, SF).groupBy("season", "league", "y").agg(F.first("n").alias("n"), F.first("need").alias("need")).collect()}
    cell = {r.match_id: (r.season, r.league, r.y) for r in training(spark, SF).collect()}
    made = __spark_entry__.queries()["PR11_geometric"](spark, SF).collect()
    counts = {}
    for r in made:
        counts[cell[r.match_id]] = counts.get(cell[r.match_id], 0) + 1
        assert r.q in (1, 2, 3, 4) and r.radius >= 0 and all(map(math.isfinite, (r.odds_h, r.odds_a)))
    assert made and counts == {k: r.need for k, r in rows.items() if r.need > 0 and r.n > 1}


def test_new_operators_take_empty_tables(spark):
    f = spark.createDataFrame([], "match_id long, match_date date, season int, league int, home_team_id int, away_team_id int, home_score int, away_score int")
    assert ratings.rate_all(f, [{}]).isEmpty()
    none = spark.createDataFrame([], "source_name string, name string")
    assert resolve(none.select("source_name"), none.select("name"), token_similarity).isEmpty()
    one = spark.createDataFrame([("a",)], "source_name string")
    assert [tuple(r) for r in resolve(one, none.select("name"), token_similarity).collect()] == [("a", None, "below_threshold", 0.0)]
    rows = spark.createDataFrame([], "id long, g int, y string, x double")
    assert balancing.short_of(rows, ["g"], "y").isEmpty()


def test_fits_have_no_more_tasks_for_more_parts(spark):
    many = spark.range(0, 1_000, 1, 50).where("id % 2 = 0")
    assert gathered(many).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < 50 and gathered(many).exceptAll(many).isEmpty() and gathered(many).count() == 500
    assert gathered(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 1


def stages(spark):
    """Rows written to shuffles, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}


def shuffled(spark, df):
    before = stages(spark)
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in stages(spark).items() if k not in before)


def test_a_grid_shuffles_each_match_once(spark):
    f = spark.createDataFrame(fixtures(spark, SF).collect(), fixtures(spark, SF).schema)
    one, many = (shuffled(spark, ratings.rate_all(f, [{"k": float(k)} for k in range(1, n + 1)])) for n in (1, 36))
    assert one == many == f.count()


def test_a_grid_of_all_settings(spark):
    f = fixtures(spark, SF).withColumn("league", F.when(F.col("league") > 0, F.col("league")))  # one league has no name
    grid = [{}, {"rate": 0.1, "home": 50.0}, {"carry": 0.5, "newcomer": 10.0, "start": 1000.0}]
    got = ratings.rate_all(f, grid)
    for i, s in enumerate(grid):
        want = ratings.rate(f, s)
        assert want.count() > 0 and got.where(F.col("candidate") == i).drop("candidate").exceptAll(want).isEmpty() and want.exceptAll(got.where(F.col("candidate") == i).drop("candidate")).isEmpty()
    part = ratings.rate_all(f, grid, ["elo_diff"], ["season"])
    assert part.columns == ["candidate", "season", "match_id", "elo_diff"]
    assert part.exceptAll(got.join(f.select("match_id", "season"), "match_id").select(*part.columns)).isEmpty() and part.count() == 3 * f.count()


def test_counted_matches_give_the_fit_of_all_matches(spark):
    f = fixtures(spark, SF.replace("0.001", "0.01")).persist()
    grid = [{"k": 10.0}, {"k": 40.0, "home": 90.0}]
    counted = counts(f, grid).persist()
    assert counted.agg(F.sum("n")).first()[0] == 2 * f.where("season <= 1999").count() > counted.count() and counted.agg(F.max("n")).first()[0] > 1
    label = F.when(F.col("home_score") > F.col("away_score"), 0.0).when(F.col("home_score") == F.col("away_score"), 1.0).otherwise(2.0)
    for i, s in enumerate(grid):
        rows = ratings.rate(f, s).join(f.select("match_id", "season", label.alias("label")), "match_id")
        rows = VectorAssembler(inputCols=["elo_expected_home"], outputCol="features").transform(rows).persist()
        want = losses(LogisticRegression(regParam=0.001, maxIter=15, family="multinomial").fit(rows.where("season <= 1998")).transform(rows.where("season = 1999"))).first()
        mine = scaled(counted).where(F.col("candidate") == i)
        fit = LogisticRegression(regParam=0.001, maxIter=15, family="multinomial", standardization=False, weightCol="n").fit(mine.where("train"))
        assert list(losses(fit.transform(mine.where("NOT train")), "n").first()) == pytest.approx(list(want), abs=1e-7)


def test_one_match_has_no_spread(spark):
    rows = [(0, True, 0.0, 0.5, 1.0), (1, True, 0.0, 0.5, 2.0), (1, True, 2.0, 0.5, 1.0), (2, False, 1.0, 0.7, 3.0)]
    got = scaled(spark.createDataFrame(rows, "candidate int, train boolean, label double, elo_expected_home double, n double")).collect()
    assert len(got) == 4 and all(list(r.features) == [0.0] for r in got)
