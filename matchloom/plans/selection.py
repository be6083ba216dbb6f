"""Choosing among models: rating grids, random search, sweeps, ablations, shrunk forests and kernel features."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.scores import clip, log_loss, rps
from matchloom.operators import shrinkage
from matchloom.operators.columns import resolve_groups
from matchloom.operators.ratings import rate_all
from matchloom.plans.models import CALIBRATE, INPUTS, TEST, TRAIN, forest, logit, matrix, named, probabilities
from matchloom.plans.registry import query
from matchloom.sources.files import kept, shared_folder
from matchloom.sources.views import fixtures

#: Fits that run at the same time; each is a Spark job of its own.
AT_ONCE = 6


def named_class():
    """H, D or A for the label 0, 1 or 2."""
    return F.element_at(F.array(*map(F.lit, "HDA")), F.col("label").cast("int") + 1)


def split_name():
    return F.when(F.expr(TRAIN), "train").when(F.expr(CALIBRATE), "validation").otherwise("test")


def candidates(space: dict[str, list], n: int, seed: int) -> list[dict]:
    """PR7: n settings of a product of values, in the order of a hash with the seed; all if there are fewer."""
    every = [dict(zip(space, v)) for v in product(*space.values())]
    return sorted(every, key=lambda c: hashlib.md5(f"{seed}:{sorted(c.items())}".encode()).hexdigest())[:n]


def losses(scored: DataFrame, n: str | None = None) -> DataFrame:
    """One row: the mean log-loss and RPS of a classifier's rows, weighed by a column n if there is one."""
    h, d, a = probabilities(scored)
    mean = lambda c: F.sum(F.col(n) * c) / F.sum(n) if n else F.avg(c)
    return scored.agg(mean(log_loss(h, d, a, named_class())).alias("log_loss"), mean(rps(h, d, named_class())).alias("rps"))


def gathered(df: DataFrame) -> DataFrame:
    """All rows of df in one part a core at most: each of a fit's many jobs has a task a part, whose report goes to the driver."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def at_once(f, items: list) -> list:
    with ThreadPool(AT_ONCE) as pool:
        return pool.map(f, items)


def counts(matches: DataFrame, grid: list[dict]) -> DataFrame:
    """(candidate, train, label, elo_expected_home, n): how many matches to 1999 have a setting's expectation and an outcome.

    It has four decimals, so there are 30,003 such rows a setting and part at most, and a fit to them weighed by n is the fit to all matches.
    """
    label = F.when(F.col("home_score") > F.col("away_score"), 0.0).when(F.col("home_score") == F.col("away_score"), 1.0).otherwise(2.0)
    rated = rate_all(matches.withColumn("label", label), grid, ["elo_expected_home"], ["season", "label"]).where("season <= 1999")
    return rated.groupBy("candidate", F.expr(TRAIN).alias("train"), "label", "elo_expected_home").agg(F.count(F.lit(1)).cast("double").alias("n"))


def scaled(counted: DataFrame) -> DataFrame:
    """features: the expectation over its standard deviation in the training matches, as a fit standardises it that has a row a match."""
    x, n = F.col("elo_expected_home"), F.when(F.col("train"), F.col("n"))
    about = F.greatest(F.sum(n * x * x) - F.sum(n * x) ** 2 / F.sum(n), F.lit(0.0))
    spread = counted.groupBy("candidate").agg(F.sqrt(F.try_divide(about, F.sum(n) - 1)).alias("sd"))  # a row a setting
    data = counted.join(F.broadcast(spread), "candidate").withColumn("x", F.when(F.col("sd") > 0, x / F.col("sd")).otherwise(0.0))
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(data).select("candidate", "train", "label", "features", "n")


@query()
def RT3_rating_grid(spark, d):
    """The validation RPS of a logit on Elo under 36 settings; all ratings come from one job, each fit is a job (RT3)."""
    grid = [{"k": k, "home": h, "carry": c} for k, h, c in product((10.0, 20.0, 30.0), (50.0, 70.0, 90.0), (0.6, 0.75, 0.9, 1.0))]
    data = kept(scaled(kept(counts(fixtures(spark, d), grid))).repartition("candidate").sortWithinPartitions("candidate"))  # a fit's many plans begin at files
    learner = LogisticRegression(regParam=0.001, maxIter=15, family="multinomial", standardization=False, weightCol="n")

    def score(i):
        mine = gathered(data.where(F.col("candidate") == i))
        return (i, *grid[i].values(), *losses(learner.fit(mine.where("train")).transform(mine.where("NOT train")), "n").first())

    rows = at_once(score, range(len(grid)))
    out = spark.createDataFrame(rows, "candidate int, k double, home double, carry double, log_loss double, rps double")  # a row a setting
    return out.withColumns({c: F.round(c, 6) for c in ("log_loss", "rps")})


SPACE = {"regParam": [0.0, 0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0], "standardization": [True, False]}


@query()
def ML10_random_search(spark, d):
    """Twelve of thirty settings of a logit, each scored on three folds of whole matches; the rows of the search, best marked (ML10, PR7)."""
    data = matrix(spark, d).where(TRAIN).withColumn("fold", F.pmod(F.crc32(F.col("match_id").cast("string")), F.lit(3))).persist()
    chosen = candidates(SPACE, 12, 1)

    def score(job):
        i, k = job
        fit = LogisticRegression(maxIter=15, family="multinomial", **chosen[i]).fit(gathered(data.where(F.col("fold") != k)))
        return i, k, losses(fit.transform(gathered(data.where(F.col("fold") == k)))).first()[0]

    found = pd.DataFrame(at_once(score, list(product(range(len(chosen)), range(3)))), columns=["candidate", "fold", "loss"])  # 36 numbers
    data.unpersist()
    mean = found.groupby("candidate").loss.mean()
    rows = [(i, float(c["regParam"]), float(c["elasticNetParam"]), bool(c["standardization"]), round(float(mean[i]), 6), bool(mean[i] == mean.min())) for i, c in enumerate(chosen)]
    return spark.createDataFrame(rows, "candidate int, reg double, elastic double, standardised boolean, log_loss double, best boolean")


def swept(spark, d) -> DataFrame:
    """(model, match_id, season, label, p_h, p_d, p_a) of each learner over all matches, fitted on the training seasons."""
    data = matrix(spark, d)
    learners = {"forest": forest(), "logit": logit(), "strong penalty": LogisticRegression(regParam=1.0, maxIter=10, family="multinomial")}

    def rows(item):
        scored = item[1].fit(data.where(TRAIN)).transform(data)
        return scored.select(F.lit(item[0]).alias("model"), "match_id", "season", "label", *named(probabilities(scored)))

    return reduce(DataFrame.unionByName, at_once(rows, list(learners.items())))


@query()
def ML11_predictions(spark, d):
    """Each model's probabilities of every match with its split; rows before the test seasons are the frozen reference."""
    return swept(spark, d).select("model", "match_id", split_name().alias("split"), (F.expr(f"NOT ({TEST})")).alias("reference"), named_class().alias("y_true"), "p_h", "p_d", "p_a")


@query()
def ML11_sweep(spark, d):
    """Each model's scores by split, from its predictions."""
    s = swept(spark, d)
    h, dr, a = F.col("p_h"), F.col("p_d"), F.col("p_a")
    return s.groupBy("model", split_name().alias("split")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(log_loss(h, dr, a, named_class())), 6).alias("log_loss"), F.round(F.avg(rps(h, dr, named_class())), 6).alias("rps"))


_RULES = [("venue", "venue"), ("form", "form"), ("ratings", "elo|pi_")]


@query()
def ML13_ablation(spark, d):
    """The test scores of a logit without each group of inputs, on half the matches, and with balanced classes (PF15, PR12)."""
    data = matrix(spark, d)
    half = F.pmod(F.crc32(F.col("match_id").cast("string")), F.lit(2)) == 0
    train = data.where(TRAIN)
    sizes = {r.label: r.n for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    weight = reduce(lambda w, i: w.when(F.col("label") == i, sum(sizes.values()) / (len(sizes) * sizes[i])), sizes, F.when(F.lit(False), 0.0))
    without = {f"without {g}": cs for g, cs in resolve_groups(INPUTS, _RULES).items()}
    arms = {"full": (train, []), "half of the matches": (train.where(half), []), "balanced": (train, []), **{n: (train, cs) for n, cs in without.items()}}

    def score(arm):
        rows, dropped = arms[arm]
        kept = [i for i, c in enumerate(INPUTS) if c not in dropped]
        cut = lambda df: gathered(df).withColumn("x", array_to_vector(F.array(*[vector_to_array("features")[i] for i in kept])))
        learner = logit().setFeaturesCol("x")
        learner = learner.setWeightCol("w") if arm == "balanced" else learner
        return arm, len(kept), *losses(learner.fit(cut(rows.withColumn("w", weight))).transform(cut(data.where(TEST)))).first()

    rows = at_once(score, list(arms))
    full = next(r for r in rows if r[0] == "full")
    return spark.createDataFrame([(n, k, round(ll, 6), round(r, 6), round(r - full[3], 6)) for n, k, ll, r in rows], "arm string, inputs int, log_loss double, rps double, change double")


#: Landmarks of the kernel features; the whitening matrix has this many rows and columns.
LANDMARKS = 50


@query()
def ML6_kernel_ridge(spark, d):
    """A ridge for the margin on Nyström features of a radial kernel, in batches of rows; margins lie in [-5, 5] (ML6)."""
    data = matrix(spark, d).withColumn("x", vector_to_array("features"))
    train = data.where(TRAIN)
    n = len(INPUTS)
    stats = train.agg(*[F.avg(F.col("x")[i]) for i in range(n)], *[F.stddev_pop(F.col("x")[i]) for i in range(n)]).first()
    mu, sd = np.array(stats[:n]), np.array(stats[n:])
    sd = np.where(sd > 0, sd, 1.0)
    marks = train.orderBy(F.md5(F.col("match_id").cast("string")), "match_id").limit(LANDMARKS).select("x").collect()
    z = (np.array([r.x for r in marks]) - mu) / sd

    def kernel(a, b):
        return np.exp(-((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T) / n)

    values, vectors = np.linalg.eigh(kernel(z, z))
    white = vectors / np.sqrt(np.maximum(values, 1e-6))

    @F.pandas_udf("array<double>")
    def features(x: pd.Series) -> pd.Series:
        return pd.Series(list(kernel((np.stack(x.to_list()) - mu) / sd, z) @ white)) if len(x) else pd.Series([], dtype=object)

    mapped = data.withColumn("phi", array_to_vector(features("x")))
    model = LinearRegression(featuresCol="phi", labelCol="margin", predictionCol="ridge", regParam=0.1, standardization=False).fit(mapped.where(TRAIN))
    return model.transform(mapped.where(TEST)).select("match_id", "margin", F.round(clip(F.col("ridge"), -5, 5), 6).alias("ridge"))


LAMBDAS = [0.0, 0.1, 1.0, 10.0, 25.0, 50.0, 100.0, 500.0]


@query()
def ML5_shrunk_forest(spark, d):
    """A forest whose leaves are shrunk towards the nodes above them, by the lambda of least loss on the validation season (ML5)."""
    data = matrix(spark, d)
    model = forest().setLeafCol("leaves").fit(data.where(TRAIN))
    leaves = shrinkage.shrink(shrinkage.nodes_of(spark, model, shared_folder(spark)), LAMBDAS, model.getMaxDepth())
    fallen = model.transform(data.where("season >= 1999")).withColumn("leaf", vector_to_array("leaves"))
    scored = shrinkage.score(fallen, "match_id", "leaf", leaves, ["season", "label"]).persist()
    p = [F.col("p")[i] for i in range(3)]
    by = scored.where(CALIBRATE).groupBy("place").agg(F.avg(log_loss(*p, named_class(), 1e-6)).alias("loss"))
    best = by.orderBy("loss", "place").first()
    place = best.place if best else 0
    return scored.where(TEST).where(F.col("place") == place).select("match_id", F.lit(LAMBDAS[place]).alias("lambda"), *named(p))
