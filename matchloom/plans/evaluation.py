"""Comparisons of forecasts: by phase, against a market, over seasons and arms; links, grids and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.normal import ordinal
from matchloom.functions.scores import brier, de_vig, log_loss, pick, rps
from matchloom.operators.windows import top
from matchloom.plans.registry import query
from matchloom.sources.views import EVENTS_SQL, FIXTURES_SQL, PREDICTIONS_SQL, fixtures, match_events, predictions

_RPS = "(power(p_h - (y = 'H')::INT, 2) + power(p_h + p_d - (y = 'H')::INT - (y = 'D')::INT, 2)) / 2"
_PICK = "CASE WHEN p_h >= p_d AND p_h >= p_a THEN 'H' WHEN p_d >= p_a THEN 'D' ELSE 'A' END"
_P_SUM = "1 / odds_h + 1 / odds_d + 1 / odds_a"
#: Three models of each priced match in long form: the forecast, the market, and equal thirds.
ARMS = f"""WITH p AS ({PREDICTIONS_SQL}), m AS (SELECT *, 1 / odds_h / o AS m_h, 1 / odds_d / o AS m_d, 1 / odds_a / o AS m_a FROM (SELECT *, {_P_SUM} AS o FROM p) WHERE o IS NOT NULL),
 arms AS (SELECT match_id, match_date, season, league, y, 'forecast' AS model, p_h, p_d, p_a FROM m UNION ALL SELECT match_id, match_date, season, league, y, 'market', m_h, m_d, m_a FROM m
  UNION ALL SELECT match_id, match_date, season, league, y, 'uniform', 1 / 3, 1 / 3, 1 / 3 FROM m),
 scored AS (SELECT *, {_RPS} AS rps, greatest(p_h, p_d, p_a) AS conf, ({_PICK} = y)::INT AS hit FROM arms)"""


def priced(spark, d):
    h, dr, a, _ = de_vig("odds_h", "odds_d", "odds_a")
    return predictions(spark, d).withColumns({"m_h": h, "m_d": dr, "m_a": a}).where("m_a IS NOT NULL")


def arms(spark, d):
    """(match, model, p_h, p_d, p_a, rps, conf, hit): the models are spread within each row, without a join."""
    third = F.lit(1 / 3)
    arm = lambda name, h, dr, a: F.struct(F.lit(name).alias("model"), h.alias("p_h"), dr.alias("p_d"), a.alias("p_a"))
    each = F.array(arm("forecast", F.col("p_h"), F.col("p_d"), F.col("p_a")), arm("market", F.col("m_h"), F.col("m_d"), F.col("m_a")), arm("uniform", third, third, third))
    long = priced(spark, d).select("match_id", "match_date", "season", "league", "y", F.explode(each).alias("e")).select("match_id", "match_date", "season", "league", "y", "e.*")
    h, dr, a = F.col("p_h"), F.col("p_d"), F.col("p_a")
    return long.withColumns({"rps": rps(h, dr, F.col("y")), "conf": F.greatest(h, dr, a), "hit": (pick(h, dr, a) == F.col("y")).cast("int")})


@query(ARMS + ", z AS (SELECT *, power(p_h - (y = 'H')::INT, 2) + power(p_d - (y = 'D')::INT, 2) + power(p_a - (y = 'A')::INT, 2) AS b, -ln(greatest(1e-15, least(1 - 1e-15, CASE y WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END))) AS ll FROM scored) SELECT model, month(match_date) AS phase, count(*) AS n, round(avg(rps), 6) AS rps, round(avg(b), 6) AS brier, round(avg(ll), 6) AS log_loss FROM z GROUP BY 1, 2")
def EV8_metric_by_phase(spark, d):
    """Proper scores of each model by phase, here the month."""
    h, dr, a = F.col("p_h"), F.col("p_d"), F.col("p_a")
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return arms(spark, d).groupBy("model", F.month("match_date").alias("phase")).agg(F.count(F.lit(1)).alias("n"), mean("rps", "rps"), mean(brier(h, dr, a, F.col("y")), "brier"), mean(log_loss(h, dr, a, F.col("y")), "log_loss"))


@query(ARMS + ", b AS (SELECT model, quarter(match_date) AS phase, least(9, floor(conf * 10)) AS bin, count(*) AS n, sum(conf) AS c, sum(hit) AS h FROM scored GROUP BY 1, 2, 3) SELECT model, phase, sum(n)::BIGINT AS n, round(sum(abs(c - h)) / sum(n), 6) AS ece, round(sum(c) / sum(n), 6) AS confidence, round(sum(h) / sum(n), 6) AS accuracy, round((sum(c) - sum(h)) / sum(n), 6) AS over FROM b GROUP BY 1, 2")
def EV9_calibration_by_phase(spark, d):
    """Expected calibration error over ten bins, mean confidence, accuracy and their gap, by phase."""
    b = arms(spark, d).groupBy("model", F.quarter("match_date").alias("phase"), F.least(F.lit(9), F.floor(F.col("conf") * 10)).alias("bin"))
    b = b.agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("c"), F.sum("hit").alias("h"))
    part = lambda c: F.round(c / F.sum("n"), 6)
    return b.groupBy("model", "phase").agg(F.sum("n").alias("n"), part(F.sum(F.abs(F.col("c") - F.col("h")))).alias("ece"), part(F.sum("c")).alias("confidence"), part(F.sum("h")).alias("accuracy"), part(F.sum("c") - F.sum("h")).alias("over"))


_TAUS = (1, 3, 6, 12, 24)


@query(ARMS + f", w AS (SELECT y, i / 50.0 AS alpha0, tau, i / 50.0 * exp(-month(match_date) / tau) AS a, p_h, p_d, m_h, m_d FROM m, range(51) g(i), (VALUES {', '.join(f'({t}.0)' for t in _TAUS)}) t(tau)), q AS (SELECT alpha0, tau, y, a * m_h + (1 - a) * p_h AS p_h, a * m_d + (1 - a) * p_d AS p_d FROM w) SELECT round(alpha0, 2) AS alpha0, tau::DOUBLE AS tau, round(avg({_RPS}), 6) AS rps FROM q GROUP BY 1, 2")
def EV12_decaying_blend(spark, d):
    """The score of each blend whose market weight alpha0 * exp(-t / tau) fades with time; 255 pairs in each row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i / 50).alias("alpha0"), F.lit(float(t)).alias("tau")) for i in range(51) for t in _TAUS]))
    w = priced(spark, d).select("y", "p_h", "p_d", "m_h", "m_d", F.month("match_date").alias("t"), pairs.alias("g"))
    a = F.col("g.alpha0") * F.exp(-F.col("t") / F.col("g.tau"))
    mix = lambda x, z: a * F.col(x) + (1 - a) * F.col(z)
    return w.groupBy(F.round("g.alpha0", 2).alias("alpha0"), F.col("g.tau").alias("tau")).agg(F.round(F.avg(rps(mix("m_h", "p_h"), mix("m_d", "p_d"), F.col("y"))), 6).alias("rps"))


@query(ARMS + f", one AS (SELECT season, model, avg(rps) AS s FROM scored GROUP BY 1, 2), best AS (SELECT season, min(round(s, 9)) AS single, arg_min(model, (round(s, 9), model)) AS model FROM one GROUP BY 1), st AS (SELECT season, avg({_RPS}) AS stack FROM (SELECT season, y, (p_h + m_h) / 2 AS p_h, (p_d + m_d) / 2 AS p_d FROM m) GROUP BY 1) SELECT season, model, round(single, 6) AS single, round(stack, 6) AS stack, round(stack - single, 6) AS delta, CASE WHEN stack < single THEN 'stack' ELSE 'single' END AS served FROM best JOIN st USING (season)")
def EV16_ensemble(spark, d):
    """The best single model of each season against the mean of forecast and market."""
    one = arms(spark, d).groupBy("season", "model").agg(F.round(F.avg("rps"), 9).alias("single"))
    best = top(one, ["season"], [F.col("single"), F.col("model")])
    mid = lambda c: (F.col(f"p_{c}") + F.col(f"m_{c}")) / 2
    st = priced(spark, d).groupBy("season").agg(F.avg(rps(mid("h"), mid("d"), F.col("y"))).alias("stack"))
    gap = F.col("stack") - F.col("single")
    return best.join(st, "season").select("season", "model", F.round("single", 6).alias("single"), F.round("stack", 6).alias("stack"), F.round(gap, 6).alias("delta"), F.when(gap < 0, "stack").otherwise("single").alias("served"))


_WORST = "CASE WHEN med > 0 AND rps > 3 * med THEN 'far above the median' WHEN conf > 0.6 THEN 'confident and wrong' ELSE 'ordinary' END"


@query(ARMS + f", k AS (SELECT *, row_number() OVER (PARTITION BY model, season ORDER BY round(rps, 9) DESC, match_id) AS rank FROM scored), md AS (SELECT model, season, median(rps) AS med FROM scored GROUP BY 1, 2) SELECT model, season, rank, match_id, round(rps, 6) AS rps, {_WORST} AS verdict FROM k JOIN md USING (model, season) WHERE rank <= 5")
def EV17_worst(spark, d):
    """The five worst forecasts of each model and season, with a verdict by rules."""
    s = arms(spark, d)
    med = s.groupBy("model", "season").agg(F.median("rps").alias("med"))
    worst = top(s, ["model", "season"], [F.round("rps", 9).desc(), F.col("match_id")], 5, "rank").join(med, ["model", "season"])
    verdict = F.when((F.col("med") > 0) & (F.col("rps") > 3 * F.col("med")), "far above the median").when(F.col("conf") > 0.6, "confident and wrong").otherwise("ordinary")
    return worst.select("model", "season", "rank", "match_id", F.round("rps", 6).alias("rps"), verdict.alias("verdict"))


@query(ARMS + ", s AS (SELECT league, model, avg(rps) AS v FROM scored GROUP BY 1, 2) SELECT s.league, s.model, round(s.v, 6) AS rps, round(s.v - f.v, 6) AS change FROM s JOIN s f ON f.league = s.league AND f.model = 'forecast'")
def AG19_arm_change(spark, d):
    """Each arm's score and its change against the full arm (AG19, EV19)."""
    s = arms(spark, d).groupBy("league", "model").agg(F.avg("rps").alias("v"))
    full = F.max(F.when(F.col("model") == "forecast", F.col("v"))).over(Window.partitionBy("league"))
    return s.select("league", "model", F.round("v", 6).alias("rps"), F.round(F.col("v") - full, 6).alias("change"))


@query(ARMS + " SELECT match_id, round(abs(p_h - round(p_h, 2)), 6) AS gap FROM p WHERE abs(p_h - round(p_h, 2)) > 5e-4")
def EV20_parity(spark, d):
    """Where a stored table (here of two digits) is more than 5e-4 off the computed one."""
    p = predictions(spark, d)
    stored = p.select("match_id", F.round("p_h", 2).alias("stored"))
    gap = F.abs(F.col("p_h") - F.col("stored"))
    return p.join(stored, "match_id").where(gap > 5e-4).select("match_id", F.round(gap, 6).alias("gap"))


@query(ARMS + " SELECT match_id, match_date, home_team_id, away_team_id, y, round(p_h, 6) AS p_h, round(odds_h, 6) AS odds_h FROM (SELECT p.*, f.home_team_id, f.away_team_id FROM p JOIN (" + FIXTURES_SQL + ") f USING (match_id)) WHERE league = 2 AND season = 1997 AND match_date >= DATE '1997-03-01'")
def EV21_lookup(spark, d):
    """Fixtures of a league, season and date with their forecast; forecasts come from the whole history."""
    on = "league = 2 AND season = 1997 AND match_date >= DATE '1997-03-01'"
    f = fixtures(spark, d).where(on).select("match_id", "home_team_id", "away_team_id")
    return predictions(spark, d).where(on).join(f, "match_id").select("match_id", "match_date", "home_team_id", "away_team_id", "y", F.round("p_h", 6).alias("p_h"), F.round("odds_h", 6).alias("odds_h"))


@query(ARMS + ", s AS (SELECT league, season, avg(rps) FILTER (WHERE model = 'forecast') - avg(rps) FILTER (WHERE model = 'market') AS x FROM scored GROUP BY 1, 2) SELECT league, count(*) AS n, round(avg(x), 6) AS mean, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 4) AS t FROM s GROUP BY 1")
def ST4_paired_t(spark, d):
    """The t statistic of paired differences, seasons as pairs."""
    of = lambda m: F.avg(F.when(F.col("model") == m, F.col("rps")))
    s = arms(spark, d).groupBy("league", "season").agg((of("forecast") - of("market")).alias("x"))
    n = F.count(F.lit(1))
    return s.groupBy("league").agg(n.alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.avg("x") / (F.stddev_samp("x") / F.sqrt(n)), 4).alias("t"))


@query(ARMS + ", s AS (SELECT model, season, avg(rps) AS x FROM scored GROUP BY 1, 2) SELECT model, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS low, round(max(x), 6) AS high FROM s GROUP BY 1")
def ST7_stability(spark, d):
    """Mean, deviation and range of each model's score over repetitions, here seasons."""
    s = arms(spark, d).groupBy("model", "season").agg(F.avg("rps").alias("x"))
    return s.groupBy("model").agg(*[F.round(f("x"), 6).alias(n) for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"), (F.min, "low"), (F.max, "high"))])


_MARGIN = "least(3, greatest(-3, ln(odds_a / odds_h)))"


def _cdf(z: str) -> str:
    x, t = f"(abs({z}) / sqrt(2.0))", f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0)))"
    poly = f"({t} * (0.254829592::DOUBLE + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))"
    erf = f"(1 - {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN (1 + {erf}) / 2 ELSE (1 - {erf}) / 2 END)"


@query(ARMS + f", z AS (SELECT match_id, 1 - {_cdf('((0.5 - g) / 1.2)')} AS h, {_cdf('((-0.5 - g) / 1.2)')} AS a FROM (SELECT match_id, {_MARGIN} AS g FROM m)) SELECT match_id, round(h, 6) AS p_h, round(1 - h - a, 6) AS p_d, round(a, 6) AS p_a FROM z")
def FN15_ordinal_link(spark, d):
    """A margin to home, draw and away probabilities by a normal error."""
    g = F.least(F.lit(3.0), F.greatest(F.lit(-3.0), F.ln(F.col("odds_a") / F.col("odds_h"))))
    return priced(spark, d).select("match_id", *[F.round(c, 6).alias(n) for c, n in zip(ordinal(g, F.lit(0.5), F.lit(1.2)), ("p_h", "p_d", "p_a"))])


_THETA, _SIGMA = (0.1, 0.2, 0.4, 0.8), (0.5, 1.0, 2.0, 4.0)


@query(ARMS + f", z AS (SELECT league, y, theta, sigma, 1 - {_cdf('((theta - g) / sigma)')} AS h, {_cdf('((-theta - g) / sigma)')} AS a FROM (SELECT league, y, {_MARGIN} AS g FROM m WHERE season = 1999), (VALUES {', '.join(f'({t}::DOUBLE)' for t in _THETA)}) t(theta), (VALUES {', '.join(f'({s}::DOUBLE)' for s in _SIGMA)}) s(sigma)), n AS (SELECT league, theta, sigma, avg(-ln(greatest(CASE y WHEN 'H' THEN h WHEN 'D' THEN 1 - h - a ELSE a END, 1e-6))) AS nll FROM z GROUP BY 1, 2, 3) SELECT league, arg_min(theta, nll) AS theta, arg_min(sigma, nll) AS sigma, round(min(nll), 5) AS nll FROM n GROUP BY 1")
def ML12_ordinal_grid(spark, d):
    """The link's threshold and deviation of least negative log-likelihood on the validation season, by league."""
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("theta"), F.lit(s).alias("sigma")) for t in _THETA for s in _SIGMA]))
    g = F.least(F.lit(3.0), F.greatest(F.lit(-3.0), F.ln(F.col("odds_a") / F.col("odds_h"))))
    rows = priced(spark, d).where("season = 1999").select("league", "y", g.alias("g"), grid.alias("c"))
    h, dr, a = ordinal(F.col("g"), F.col("c.theta"), F.col("c.sigma"))
    loss = -F.ln(F.greatest(F.when(F.col("y") == "H", h).when(F.col("y") == "D", dr).otherwise(a), F.lit(1e-6)))
    n = rows.groupBy("league", "c").agg(F.avg(loss).alias("nll"))
    return n.groupBy("league").agg(F.min_by("c", "nll").alias("c"), F.round(F.min("nll"), 5).alias("nll")).select("league", "c.theta", "c.sigma", "nll")


@query(f"WITH f AS ({FIXTURES_SQL}), v AS (SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) AS k, count(*) OVER () AS n FROM f WHERE season = 1999) SELECT match_id, k <= round(0.6 * n) AS meta_train FROM v")
def ML9_meta_holdout(spark, d):
    """The earliest 60 in a hundred of the validation matches; dates are counted first, so only ranks within a day are sorted."""
    v = fixtures(spark, d).where("season = 1999").select("match_id", "match_date")
    days = v.groupBy("match_date").agg(F.count(F.lit(1)).alias("n"))  # a row for each calendar day
    w = Window.orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("match_date", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    k = F.col("before") + F.row_number().over(Window.partitionBy("match_date").orderBy("match_id"))
    return v.join(F.broadcast(days), "match_date").select("match_id", (k <= F.round(0.6 * F.col("total"))).alias("meta_train"))


@query(f"WITH e AS ({EVENTS_SQL}), m AS (SELECT match_id FROM e GROUP BY 1 ORDER BY md5(match_id::VARCHAR), match_id LIMIT 50) SELECT match_id, event_id, type FROM e WHERE match_id IN (SELECT match_id FROM m)")
def PR6_cluster_sample(spark, d):
    """A sample of 50 whole matches by a hash of their id (a sampling operator)."""
    e = match_events(spark, d)
    chosen = e.select("match_id").distinct().orderBy(F.md5(F.col("match_id").cast("string")), "match_id").limit(50)
    return e.join(F.broadcast(chosen), "match_id", "left_semi").select("match_id", "event_id", "type")


@query(f"WITH e AS ({EVENTS_SQL}) SELECT family, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT value, CASE WHEN type LIKE '%ch%' THEN 'market' WHEN type LIKE 'v%' OR type LIKE 'c%' THEN 'touch' ELSE 'other' END AS family FROM e) GROUP BY 1")
def PF10_families(spark, d):
    """Names to families by ordered rules, with each family's sum."""
    t = F.col("type")
    family = F.when(t.contains("ch"), "market").when(t.startswith("v") | t.startswith("c"), "touch").otherwise("other")
    return match_events(spark, d).groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value").cast("double"), 2).alias("total"))
