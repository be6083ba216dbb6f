"""Intervals and p-values for differences between models, by resampled matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators.resampling import PRIME, REACHED, intervals, paired_losses
from matchloom.plans.registry import query
from matchloom.plans.shapes import _LONG, losses

_PART = "('0x' || substr(md5(match_id::VARCHAR), {}, 8))::BIGINT % " + str(PRIME)
_COUNT = " + ".join(f"(u >= {t})::INT" for t in REACHED)
_MEANS = (
    _LONG
    + f""", d AS (SELECT a.model AS a, b.model AS b, match_id, avg(a.loss - b.loss) AS v FROM l a JOIN l b USING (match_id) WHERE a.model < b.model GROUP BY ALL),
 u AS (SELECT a, b, v, k, ({_PART.format(1)} + k * ({_PART.format(9)}) + k * k * ({_PART.format(17)})) % {PRIME} AS u FROM d, range(2001) g(k)),
 w AS (SELECT a, b, v, k, CASE WHEN k = 0 THEN 1 ELSE {_COUNT} END AS w FROM u),
 means AS (SELECT a, b, k, sum(w * v) / sum(w) AS mean FROM w GROUP BY ALL),
 o AS (SELECT *, max(CASE WHEN k = 0 THEN mean END) OVER (PARTITION BY a, b) AS observed FROM means),
 c AS (SELECT a, b, count(*) AS n, avg((v < 0)::INT) AS share FROM d GROUP BY ALL) """
)


def _pairs(spark, d):
    return intervals(paired_losses(losses(spark, d), "match_id", [], "model", "loss"), ["a", "b"], "match_id", "difference")


@query(_MEANS + "SELECT a, b, any_value(n) AS n, round(any_value(observed), 6) AS observed, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, round(avg((abs(mean - observed) >= abs(observed))::INT), 6) AS p FROM o JOIN c USING (a, b) WHERE k > 0 GROUP BY a, b")
def ST2_intervals(spark, d):
    """Each pair of models: the mean loss difference over matches, its interval from 2,000 resamples of whole matches, and the centred p."""
    return _pairs(spark, d).select("a", "b", "n", *[F.round(c, 6).alias(c) for c in ("observed", "low", "high")], F.round("p_centred", 6).alias("p"))


@query(_MEANS + "SELECT a, b, any_value(n) AS n, round(least(1.0, 2 * least(avg((mean > 0)::INT), avg((mean < 0)::INT))), 6) AS p, round(any_value(share), 6) AS share_better FROM o JOIN c USING (a, b) WHERE k > 0 GROUP BY a, b")
def ST3_signs(spark, d):
    """Each pair of models: twice the smaller share of the resampled means' signs, and on which share of matches the first is better."""
    return _pairs(spark, d).select("a", "b", "n", F.round("p_signs", 6).alias("p"), F.round("share_below", 6).alias("share_better"))
