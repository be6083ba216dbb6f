"""Learners over pre-match features: trained on seasons to 1998, calibrated on 1999, applied to those after."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.scores import clip, floored, result
from matchloom.operators.ratings import rate
from matchloom.operators.windows import top
from matchloom.plans.forecasting import prematch
from matchloom.plans.registry import query
from matchloom.sources.views import FIXTURES_SQL, dated_ratings, fixtures, table

INPUTS = ["diff_form_points", "diff_venue_points", "diff_form_gf", "elo_expected_home", "pi_expected_gd"]
TRAIN, CALIBRATE, TEST = "season <= 1998", "season = 1999", "season >= 2000"
FOLDS = 3


def matrix(spark, d):
    """(match_id, season, label 0 1 2 for H D A, margin, features), kept for the many reads of a fit."""
    f = fixtures(spark, d)
    y = F.when(F.col("home_score") > F.col("away_score"), 0.0).when(F.col("home_score") == F.col("away_score"), 1.0).otherwise(2.0)
    margin = clip((F.col("home_score") - F.col("away_score")).cast("double"), -5, 5)
    data = f.select("match_id", "season", y.alias("label"), margin.alias("margin")).join(prematch(f), "match_id").join(rate(f), "match_id").na.fill(0.0, INPUTS)
    data = data.select("match_id", "season", "label", "margin", *[F.col(c).cast("double") for c in INPUTS])
    return VectorAssembler(inputCols=INPUTS, outputCol="features").transform(data).select("match_id", "season", "label", "margin", "features").persist()


def forest(seed=1):
    return RandomForestClassifier(numTrees=20, maxDepth=5, minInstancesPerNode=5, seed=seed)


def logit():
    return LogisticRegression(regParam=0.01, maxIter=30, family="multinomial")


def probabilities(scored):
    return [vector_to_array("probability")[i] for i in range(3)]


def named(cols):
    return [F.round(c, 6).alias(n) for c, n in zip(cols, ("p_h", "p_d", "p_a"))]


@query()
def ML2_forest(spark, d):
    """A random forest's test probabilities."""
    data = matrix(spark, d)
    scored = forest().fit(data.where(TRAIN)).transform(data.where(TEST))
    return scored.select("match_id", *named(probabilities(scored)))


@query()
def ML3_boosting(spark, d):
    """Boosted trees for the margin, and a ridge (ML4) beside them; margins lie in [-5, 5]."""
    data = matrix(spark, d)
    boosted = GBTRegressor(labelCol="margin", predictionCol="boosted", maxIter=10, maxDepth=3, seed=1).fit(data.where(TRAIN))
    ridge = LinearRegression(labelCol="margin", predictionCol="ridge", regParam=0.1).fit(data.where(TRAIN))
    scored = ridge.transform(boosted.transform(data.where(TEST)))
    return scored.select("match_id", "margin", *[F.round(clip(F.col(c), -5, 5), 6).alias(c) for c in ("boosted", "ridge")])


@query()
def ML7_calibrated(spark, d):
    """A forest calibrated one class against the rest by isotonic regression on the calibration season, floored, summing to 1."""
    data = matrix(spark, d)
    model = forest().fit(data.where(TRAIN))
    raw = model.transform(data.where("season >= 1999"))
    raw = raw.select("match_id", "season", "label", *[c.alias(f"raw_{i}") for i, c in enumerate(probabilities(raw))]).persist()
    out = raw.where(TEST)
    for i in range(3):
        fit = IsotonicRegression(featuresCol=f"raw_{i}", labelCol="is", predictionCol=f"cal_{i}")
        out = fit.fit(raw.where(CALIBRATE).withColumn("is", (F.col("label") == i).cast("double"))).transform(out)
    return out.select("match_id", *named(floored([F.col(f"cal_{i}") for i in range(3)])))


@query()
def ML8_stack(spark, d):
    """Forest and logit, out of fold by whole matches, under a logit on their probabilities."""
    data = matrix(spark, d).withColumn("fold", F.pmod(F.crc32(F.col("match_id").cast("string")), F.lit(FOLDS)))

    def members(fitted_on, of):
        for k, learner in enumerate((forest(), logit())):
            of = learner.fit(fitted_on).transform(of)
            of = of.withColumn(f"m{k}", F.col("probability")).drop("rawPrediction", "probability", "prediction")
        return of

    train = data.where(TRAIN)
    unseen = reduce(lambda a, b: a.unionByName(b), [members(train.where(F.col("fold") != k), train.where(F.col("fold") == k)) for k in range(FOLDS)])
    both = VectorAssembler(inputCols=["m0", "m1"], outputCol="meta")
    meta = logit().setFeaturesCol("meta").fit(both.transform(unseen))
    scored = meta.transform(both.transform(members(train, data.where(TEST))))
    return scored.select("match_id", *named(probabilities(scored)))


@query()
def ML14_seeds(spark, d):
    """The test log-loss of a forest under three seeds; a row for each."""
    data = matrix(spark, d)

    def loss(seed):
        scored = forest(seed).fit(data.where(TRAIN)).transform(data.where(TEST))
        p = F.element_at(vector_to_array("probability"), F.col("label").cast("int") + 1)
        return scored.agg(F.lit(seed).alias("seed"), F.round(F.avg(-F.ln(F.greatest(p, F.lit(1e-15)))), 6).alias("log_loss"))

    return reduce(lambda a, b: a.unionByName(b), map(loss, (1, 2, 3)))


@query()
def EV18_attribution(spark, d):
    """Mean absolute contribution of each input to a ridge's margin, against the mean match."""
    data = matrix(spark, d)
    model = LinearRegression(labelCol="margin", regParam=0.1).fit(data.where(TRAIN))
    x = data.where(TEST).select(vector_to_array("features").alias("x"))
    means = x.agg(*[F.avg(F.col("x")[i]).alias(f"mean_{i}") for i in range(len(INPUTS))])  # one row
    parts = F.array(*[F.struct(F.lit(n).alias("input"), F.abs((F.col("x")[i] - F.col(f"mean_{i}")) * float(model.coefficients[i])).alias("part")) for i, n in enumerate(INPUTS)])
    long = x.join(F.broadcast(means)).select(F.explode(parts).alias("p"))
    return long.groupBy(F.col("p.input").alias("input")).agg(F.round(F.avg("p.part"), 6).alias("mean_abs"))


_H = "('0x' || substr(md5({} || ':' || match_id || ':' || copy), 1, 8))::BIGINT"
_CELL = "(PARTITION BY season, league, y ORDER BY odds_h, match_id)"


@query(f"""WITH f AS ({FIXTURES_SQL}), t AS (SELECT match_id, season, league, CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS y, odds_h, odds_a FROM f WHERE season <= 1998 AND odds_h IS NOT NULL AND odds_a IS NOT NULL),
 c AS (SELECT season, league, y, count(*) AS n, max(count(*)) OVER (PARTITION BY season, league) AS most FROM t GROUP BY 1, 2, 3),
 k AS (SELECT t.*, n, most, row_number() OVER {_CELL} AS k FROM t JOIN c USING (season, league, y)),
 s AS (SELECT *, unnest(range((most - n) // n + CASE WHEN k <= (most - n) % n THEN 1 ELSE 0 END)) AS copy FROM k),
 p AS (SELECT s.*, {_H.format("'u'")} / 4294967296.0 AS u, (k - 1 + 1 + {_H.format("'n'")} % 5) % n + 1 AS j FROM s)
 SELECT p.match_id, p.copy, p.y, round(p.odds_h + p.u * (q.odds_h - p.odds_h), 6) AS odds_h, round(p.odds_a + p.u * (q.odds_a - p.odds_a), 6) AS odds_a
 FROM p JOIN k q ON q.season = p.season AND q.league = p.league AND q.y = p.y AND q.k = p.j""")
def PR8_oversample(spark, d):
    """Synthetic rows that even out the classes of each training season and league.

    Each lies between a row and one of its five successors in the order of the first price, round its class's end, so
    that neighbours come from one sort and no pairs are made. Draws are hashes, so reruns agree.
    """
    f = fixtures(spark, d).withColumn("y", result("home_score", "away_score")).where("season <= 1998 AND odds_h IS NOT NULL AND odds_a IS NOT NULL")
    cell = ["season", "league", "y"]
    sizes = f.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("most", F.max("n").over(Window.partitionBy("season", "league")))
    k = f.join(sizes, cell).withColumn("k", F.row_number().over(Window.partitionBy(*cell).orderBy("odds_h", "match_id"))).select("match_id", *cell, "odds_h", "odds_a", "n", "most", "k")
    need = F.col("most") - F.col("n")
    times = F.floor(need / F.col("n")) + F.when(F.col("k") <= need % F.col("n"), 1).otherwise(0)
    s = k.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    h = lambda tag: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(tag), "match_id", "copy")), 1, 8), 16, 10).cast("long")
    p = s.withColumns({"u": h("u") / 4294967296.0, "j": (F.col("k") + h("n") % 5) % F.col("n") + 1})
    q = k.select(*cell, F.col("k").alias("j"), F.col("odds_h").alias("h2"), F.col("odds_a").alias("a2"))
    mix = lambda a, b: F.round(F.col(a) + F.col("u") * (F.col(b) - F.col(a)), 6).alias(a)
    return p.join(q, [*cell, "j"]).select("match_id", "copy", "y", mix("odds_h", "h2"), mix("odds_a", "a2"))


_RATED = "SELECT l_partkey AS player, l_shipdate::DATE AS effective_date, max(l_quantity) AS overall FROM lineitem GROUP BY 1, 2"


@query(f"WITH a AS ({_RATED}), b AS (SELECT l_partkey AS player, l_shipdate::DATE AS effective_date, min(l_quantity) AS overall FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), u AS (SELECT *, 'first' AS source, 1 AS rank FROM a WHERE player % 2 = 0 UNION ALL SELECT *, 'second', 2 FROM b) SELECT player, effective_date, overall::DOUBLE AS overall, source FROM (SELECT *, row_number() OVER (PARTITION BY player, effective_date ORDER BY rank) AS k FROM u) WHERE k = 1")
def FP14_rating_snapshots(spark, d):
    """Dated ratings of two sources; the first one's stays where both have a player's day."""
    rows = table(spark, d, "lineitem").where("l_returnflag = 'A'")
    second = rows.groupBy(F.col("l_partkey").alias("player"), F.col("l_shipdate").cast("date").alias("effective_date")).agg(F.min("l_quantity").alias("overall"))
    tag = lambda df, name, rank: df.withColumns({"source": F.lit(name), "rank": F.lit(rank)})
    u = tag(dated_ratings(spark, d).where("player % 2 = 0"), "first", 1).unionByName(tag(second, "second", 2))
    return top(u, ["player", "effective_date"], [F.col("rank")]).select("player", "effective_date", F.col("overall").cast("double").alias("overall"), "source")


@query("WITH a AS (SELECT l_suppkey AS team, l_orderkey AS match_id, l_partkey AS player FROM lineitem GROUP BY 1, 2, 3), h AS (SELECT team, player, count(*) AS starts FROM a GROUP BY 1, 2), e AS (SELECT team, player, row_number() OVER (PARTITION BY team ORDER BY starts DESC, player) AS slot FROM h), l AS (SELECT team, max(match_id) AS match_id FROM a GROUP BY 1) SELECT team, player, 'actual' AS kind FROM a JOIN l USING (team, match_id) UNION ALL SELECT team, player, 'expected' FROM e WHERE slot <= 11")
def FP12_lineups(spark, d):
    """Each team's last line-up, and the eleven with the most starts."""
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("team"), F.col("l_orderkey").alias("match_id"), F.col("l_partkey").alias("player")).distinct()
    last = a.groupBy("team").agg(F.max("match_id").alias("match_id"))
    starts = a.groupBy("team", "player").agg(F.count(F.lit(1)).alias("starts"))
    expected = top(starts, ["team"], [F.col("starts").desc(), F.col("player")], 11)
    return a.join(last, ["team", "match_id"]).select("team", "player", F.lit("actual").alias("kind")).unionByName(expected.select("team", "player", F.lit("expected").alias("kind")))
