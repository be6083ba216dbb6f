"""Resampled means against counts drawn one by one, and their SQL."""

import hashlib
import math
import os
import random
import statistics

import duckdb
import pytest

import __spark_entry__
from matchloom.operators import resampling

SF = "/root/testdata/sf0.01"
SCHEMA = "pair string, match_id long, loss double"


def drawn(cluster, k):
    """How often draw k takes a cluster: the quantile of a Poisson variable, from its probabilities."""
    digest = hashlib.md5(str(cluster).encode()).hexdigest()
    a, b, c = (int(digest[at : at + 8], 16) % resampling.PRIME for at in (0, 8, 16))
    u, n, reached = (a + k * b + k * k * c) % resampling.PRIME, 0, math.exp(-1)
    while u / resampling.PRIME >= reached:
        n += 1
        reached += math.exp(-1) / math.factorial(n)
    return n


def test_means_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(40), rng.gauss(0, 1)) for _ in range(300)]
    rows += [("x", None, 5.0), ("x", 3, None), ("y", 4, float("nan"))] + rows[:20]
    got = resampling.resampled_means(spark.createDataFrame(rows, SCHEMA).repartition(3), ["pair"], "match_id", "loss", draws=50).collect()
    assert len(got) == 3 * 51
    for r in got:
        of = {}
        for pair, match, loss in rows:
            if pair == r.pair and match is not None and loss is not None and loss == loss:
                of.setdefault(match, []).append(loss)
        means = {match: sum(x) / len(x) for match, x in of.items()}
        times = {match: drawn(match, r.draw) if r.draw else 1 for match in means}
        assert r["mean"] == pytest.approx(sum(times[m] * means[m] for m in means) / sum(times.values()))
        assert (r.n, r.below) == (len(means), sum(x < 0 for x in means.values()))


def test_counts_are_those_of_resampling():
    counts = [drawn(match, k) for match in range(200) for k in range(1, 101)]
    assert statistics.mean(counts) == pytest.approx(1, abs=0.03) and statistics.variance(counts) == pytest.approx(1, abs=0.05)


def test_intervals(spark):
    rng = random.Random(5)
    rows = [(pair, m, rng.gauss(mean, 1)) for pair, mean in (("none", 0.0), ("large", 0.5)) for m in range(400)]
    got = {r.pair: r for r in resampling.intervals(spark.createDataFrame(rows, SCHEMA), ["pair"], "match_id", "loss").collect()}
    for pair, r in got.items():
        x = [v for p, _, v in rows if p == pair]
        error = statistics.stdev(x) / 20
        assert r.observed == pytest.approx(statistics.mean(x))
        assert (r.high - r.low) / (2 * 1.96 * error) == pytest.approx(1, abs=0.06)
        normal = math.erfc(abs(r.observed) / error / math.sqrt(2))
        assert r.p_centred == pytest.approx(normal, abs=0.04) and r.p_signs == pytest.approx(normal, abs=0.05)
        assert r.share_below == sum(v < 0 for v in x) / 400


def test_many_groups_and_none(spark):
    rows = [(str(i % 700), i, float(i)) for i in range(2_100)]  # more groups than a task holds
    got = resampling.resampled_means(spark.createDataFrame(rows, SCHEMA).coalesce(1), ["pair"], "match_id", "loss", draws=2).where("draw = 0").collect()
    assert {r.pair: (r.n, r["mean"]) for r in got} == {str(i): (3, i + 700.0) for i in range(700)}
    assert resampling.intervals(spark.createDataFrame([], SCHEMA), ["pair"], "match_id", "loss").count() == 0
    whole = resampling.intervals(spark.createDataFrame(rows, SCHEMA), [], "match_id", "loss", draws=20).collect()
    assert [(r.n, r.observed) for r in whole] == [(2_100, 1_049.5)]


def test_pairs_share_rows(spark):
    rows = [("m", 1, 10, 0.5), ("k", 1, 10, 0.2), ("m", 1, 20, 0.1), ("k", 1, 20, 0.4), ("m", 2, 10, 0.3)]
    df = spark.createDataFrame(rows, "model string, match_id long, minute int, loss double")
    got = resampling.paired_losses(df, "match_id", ["minute"], "model", "loss").collect()
    assert sorted((r.a, r.b, r.match_id, round(r.difference, 9)) for r in got) == [("k", "m", 1, -0.3), ("k", "m", 1, 0.3)]


@pytest.mark.parametrize("name", ["ST2_intervals", "ST3_signs"])
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert len(want) == 3 and sorted(map(tuple, got.select(*cols).collect())) == sorted(want)
