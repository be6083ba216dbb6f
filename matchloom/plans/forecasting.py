"""Feature pipelines, ratings, forecasts and their evaluation, statistics, preparation, models and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.scores import brier, de_vig, floored, log_loss, pick, result, rps
from matchloom.operators import temporal, windows
from matchloom.operators.contracts import expect
from matchloom.operators.ratings import rate
from matchloom.plans.registry import query
from matchloom.sources.views import EVENTS_SQL, FIXTURES_SQL, PREDICTIONS_SQL, appearances, dated_ratings, fixtures, match_events, parts, predictions, table
from matchloom.streaming import live

FX = f"WITH f AS ({FIXTURES_SQL}) "
RES = "CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END"
LONG = """l AS (SELECT match_id, match_date, home_team_id AS team, away_team_id AS opp, 'home' AS venue, home_score AS gf, away_score AS ga FROM f
  UNION ALL SELECT match_id, match_date, away_team_id, home_team_id, 'away', away_score, home_score FROM f),
 p AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS points FROM l)"""
P = f"WITH p AS ({PREDICTIONS_SQL}) "
COLS = ["form_points", "form_gf", "form_ga", "venue_points", "h2h_points", "rest_days", "played_prior"]


def team_rows(f):
    """ST-U6: two rows of a match, each from one team's side, in one pass over the input."""
    side = lambda v, t, o, gf, ga: F.struct(F.lit(v).alias("venue"), F.col(t).alias("team"), F.col(o).alias("opp"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    both = F.array(side("home", "home_team_id", "away_team_id", "home_score", "away_score"), side("away", "away_team_id", "home_team_id", "away_score", "home_score"))
    rows = f.select("match_id", "match_date", "season", "league", F.inline(both))
    return rows.withColumn("points", F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0))


def prematch(f):
    order = ["match_date", "match_id"]
    t = windows.prior_mean(team_rows(f), ["team"], order, {"form_points": "points", "form_gf": "gf", "form_ga": "ga"}, 5)
    t = windows.prior_mean(t, ["team", "venue"], order, {"venue_points": "points"}, 5)
    t = windows.prior_mean(t, ["team", "opp"], order, {"h2h_points": "points"}, 3)
    w = Window.partitionBy("team").orderBy(*order)
    t = t.withColumns({"rest_days": F.datediff("match_date", F.lag("match_date").over(w)), "played_prior": F.row_number().over(w) - 1})
    return windows.home_away(t, "match_id", COLS)


_W = "OVER (PARTITION BY {} ORDER BY match_date, match_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
_FORM = f"""q AS (SELECT match_id, venue, avg(points) {_W.format('team', 5)} AS form_points, avg(gf) {_W.format('team', 5)} AS form_gf, avg(ga) {_W.format('team', 5)} AS form_ga,
 avg(points) {_W.format('team, venue', 5)} AS venue_points, avg(points) {_W.format('team, opp', 3)} AS h2h_points,
 date_diff('day', lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id), match_date) AS rest_days, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id) - 1 AS played_prior FROM p)"""
_PIVOT = ", ".join(f"round(h.{c}, 6) AS home_{c}, round(a.{c}, 6) AS away_{c}, round(h.{c} - a.{c}, 6) AS diff_{c}" for c in COLS)


@query(f"WITH f AS ({FIXTURES_SQL}), {LONG}, {_FORM} SELECT h.match_id, {_PIVOT} FROM q h JOIN q a ON h.match_id = a.match_id AND h.venue = 'home' AND a.venue = 'away'")
def FP7_prematch_features(spark, d):
    """Form, venue form, meetings, rest and appearances before each match (WN1-WN5), home, away and difference (JN13, FP8)."""
    out = prematch(fixtures(spark, d))
    return out.select("match_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in out.columns if c != "match_id"])


_GRID = "SELECT DISTINCT match_id, team_id, CAST(t AS INT) AS t FROM v, range(0, 31, 5) g(t)"


@query(f"""WITH e AS ({EVENTS_SQL}), v AS (SELECT *, max(minute) OVER (PARTITION BY match_id ORDER BY idx) AS eff FROM e), g AS ({_GRID})
 SELECT g.match_id, g.team_id, g.t, count(v.event_id) AS events, count(*) FILTER (WHERE type = 'purchase') AS shots, count(*) FILTER (WHERE type = 'purchase' AND value > 100) AS goals, count(*) FILTER (WHERE type = 'error') AS fouls, count(*) FILTER (WHERE x >= 80) AS touches,
 count(*) FILTER (WHERE eff >= g.t - 10) AS recent_events, count(*) FILTER (WHERE eff >= g.t - 10 AND type = 'purchase') AS recent_shots
 FROM g LEFT JOIN v ON v.match_id = g.match_id AND v.team_id = g.team_id AND v.eff <= g.t GROUP BY ALL""")
def ES1_snapshots(spark, d):
    """Strict-prefix counts (ES1, ES4, JN11, ES6) and those of the last 10 minutes (ES2) on the grid."""
    s = temporal.prefix_snapshots(match_events(spark, d), 5, 30, 10)
    return s.select("match_id", "team_id", "t", "events", "shots", "goals", "fouls", "touches", "recent_events", "recent_shots")


@query(f"""WITH e AS ({EVENTS_SQL}), v AS (SELECT *, max(minute) OVER (PARTITION BY match_id ORDER BY idx) AS eff FROM e), g AS ({_GRID}),
 s AS (SELECT g.match_id, g.team_id, g.t, count(v.event_id) AS events, count(*) FILTER (WHERE type = 'purchase') AS shots FROM g LEFT JOIN v ON v.match_id = g.match_id AND v.team_id = g.team_id AND v.eff <= g.t GROUP BY ALL)
 SELECT h.match_id, h.t, 30 - h.t AS remaining, h.events - a.events AS diff_events, round((h.shots - a.shots) / greatest(h.t, 1), 6) AS diff_shots_rate FROM s h JOIN s a ON h.match_id = a.match_id AND h.t = a.t AND h.team_id = 0 AND a.team_id = 1""")
def FP13_inplay_features(spark, d):
    """Home less away on every snapshot, and rates a minute (ES3)."""
    s = temporal.prefix_snapshots(match_events(spark, d), 5, 30, 10)
    side = lambda c, k: F.max(F.when(F.col("team_id") == k, F.col(c)))
    w = s.groupBy("match_id", "t").agg((side("events", 0) - side("events", 1)).alias("diff_events"), (side("shots", 0) - side("shots", 1)).alias("diff_shots"))
    return w.where("diff_events IS NOT NULL").select("match_id", "t", (30 - F.col("t")).alias("remaining"), "diff_events", F.round(F.col("diff_shots") / F.greatest(F.col("t"), F.lit(1)), 6).alias("diff_shots_rate"))


@query("SELECT DISTINCT o_custkey AS member, cast(date_trunc('month', o_orderdate) AS date) + to_months(k::INT) AS month FROM orders, range(1, 13) g(k)".replace("cast(date_trunc('month', o_orderdate) AS date) + to_months(k::INT)", "cast(date_trunc('month', o_orderdate) + to_months(k::INT) AS date)"))
def ES7_rosters(spark, d):
    """An appearance in a month makes a member of the next 12 months."""
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("member"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("m")).distinct()
    return m.select("member", F.explode(F.expr("sequence(add_months(m, 1), add_months(m, 12), interval 1 month)")).alias("month")).distinct()


@query("""WITH r AS (SELECT l_partkey AS player, cast(l_shipdate AS date) AS dt, max(l_quantity) AS overall FROM lineitem GROUP BY 1, 2),
 l AS (SELECT DISTINCT l_orderkey, l_partkey AS player, cast(o_orderdate AS date) AS match_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 j AS (SELECT l.*, r.overall FROM l ASOF LEFT JOIN r ON l.player = r.player AND l.match_date > r.dt)
 SELECT l_orderkey, round(avg(overall), 6) AS mean, max(overall) AS best, count(overall) AS rated, count(*) AS slots FROM j GROUP BY 1""")
def FP10_lineup_strength(spark, d):
    """A line-up's ratings as of the match (FP10, FP11, ES8): mean, best, how many are known."""
    n = parts(spark, d, "lineitem", 2)  # a row of each side
    j = temporal.asof_join(appearances(spark, d), dated_ratings(spark, d), "player", "match_date", "effective_date", "overall", n)
    return j.groupBy("l_orderkey").agg(F.round(F.avg("overall"), 6).alias("mean"), F.max("overall").alias("best"), F.count("overall").alias("rated"), F.count(F.lit(1)).alias("slots"))


@query(FX + "SELECT unnest(['result in domain', 'teams differ', 'prices above 1', 'scores from 0']) AS \"check\", unnest([0, 0, count_if(NOT coalesce(odds_h > 1 AND odds_d > 1 AND odds_a > 1, false)), 0]) AS violations FROM f")
def EX2_contract(spark, d):
    """Row checks in one pass (EX2, EX3, EX8)."""
    f = fixtures(spark, d)
    return expect(f, {
        "result in domain": result("home_score", "away_score").isin("H", "D", "A"), "teams differ": F.col("home_team_id") != F.col("away_team_id"),
        "prices above 1": (F.col("odds_h") > 1) & (F.col("odds_d") > 1) & (F.col("odds_a") > 1), "scores from 0": (F.col("home_score") >= 0) & (F.col("away_score") >= 0),
    })


_SCORES = """round(avg((power(p_h - (y = 'H')::INT, 2) + power(p_h + p_d - (y = 'H')::INT - (y = 'D')::INT, 2)) / 2), 6) AS rps,
 round(avg(power(p_h - (y = 'H')::INT, 2) + power(p_d - (y = 'D')::INT, 2) + power(p_a - (y = 'A')::INT, 2)), 6) AS brier,
 round(avg(-ln(CASE y WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END)), 6) AS log_loss"""


@query(P + f"SELECT coalesce(league::VARCHAR, 'ALL') AS league, count(*) AS n, {_SCORES} FROM p GROUP BY ROLLUP (league)")
def EV1_scores(spark, d):
    """RPS, Brier score and log-loss by league and over all (EV1, EV2, EV15, WN15)."""
    h, dr, a, y = (F.col(c) for c in ("p_h", "p_d", "p_a", "y"))
    s = predictions(spark, d).withColumns({"s1": rps(h, dr, y), "s2": brier(h, dr, a, y), "s3": log_loss(h, dr, a, y)})
    r = s.rollup("league").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("s1", "rps"), ("s2", "brier"), ("s3", "log_loss"))])
    return r.withColumn("league", F.coalesce(F.col("league").cast("string"), F.lit("ALL")))


_PICK = "CASE WHEN p_h >= p_d AND p_h >= p_a THEN 'H' WHEN p_d >= p_a THEN 'D' ELSE 'A' END"


@query(P + f", b AS (SELECT least(greatest(ceil(round(greatest(p_h, p_d, p_a) * 10, 9)), 1), 10)::INT AS bin, greatest(p_h, p_d, p_a) AS conf, (y = {_PICK})::INT AS hit FROM p) SELECT bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg(hit), 6) AS accuracy, round(abs(avg(conf) - avg(hit)) * count(*) / sum(count(*)) OVER (), 6) AS weighted_gap FROM b GROUP BY 1")
def EV3_reliability(spark, d):
    """Reliability in ten bins (lo, hi] of the largest probability; the gaps add up to the calibration error (EV3-EV5, FN14)."""
    h, dr, a = (F.col(c) for c in ("p_h", "p_d", "p_a"))
    conf = F.greatest(h, dr, a)
    b = predictions(spark, d).select(F.least(F.greatest(F.ceil(F.round(conf * 10, 9)), F.lit(1)), F.lit(10)).cast("int").alias("bin"), conf.alias("conf"), (F.col("y") == pick(h, dr, a)).cast("int").alias("hit"))
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("c"), F.avg("hit").alias("r"))
    total = F.sum("n").over(Window.partitionBy())  # ten rows
    return g.select("bin", "n", F.round("c", 6).alias("confidence"), F.round("r", 6).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("r")) * F.col("n") / total, 6).alias("weighted_gap"))


@query(P + f", q AS (SELECT y, {_PICK} AS yhat FROM p) SELECT c AS class, count_if(y = c) AS support, round(CASE WHEN count_if(yhat = c) > 0 THEN count_if(y = c AND yhat = c) / count_if(yhat = c) ELSE 0 END, 6) AS precision, round(CASE WHEN count_if(y = c) > 0 THEN count_if(y = c AND yhat = c) / count_if(y = c) ELSE 0 END, 6) AS recall FROM q, (VALUES ('H'), ('D'), ('A')) k(c) GROUP BY c")
def EV6_per_class(spark, d):
    q = predictions(spark, d).select("y", pick(F.col("p_h"), F.col("p_d"), F.col("p_a")).alias("yhat")).select("y", "yhat", F.explode(F.array(*map(F.lit, "HDA"))).alias("class"))
    hit, said, was = F.count_if((F.col("y") == F.col("class")) & (F.col("yhat") == F.col("class"))), F.count_if(F.col("yhat") == F.col("class")), F.count_if(F.col("y") == F.col("class"))
    part = lambda n: F.round(F.when(n > 0, hit / n).otherwise(0.0), 6)
    return q.groupBy("class").agg(was.alias("support"), part(said).alias("precision"), part(was).alias("recall"))


_MARKET = "m AS (SELECT *, 1 / odds_h / o AS m_h, 1 / odds_d / o AS m_d, 1 / odds_a / o AS m_a FROM (SELECT *, 1 / odds_h + 1 / odds_d + 1 / odds_a AS o FROM p) WHERE o IS NOT NULL)"


def with_market(p):
    h, dr, a, _ = de_vig("odds_h", "odds_d", "odds_a")
    return p.withColumns({"m_h": h, "m_d": dr, "m_a": a}).where("m_a IS NOT NULL")


@query(f"WITH p AS ({PREDICTIONS_SQL}), {_MARKET}, g AS (SELECT a / 50.0 AS alpha, y, a / 50.0 * m_h + (1 - a / 50.0) * p_h AS p_h, a / 50.0 * m_d + (1 - a / 50.0) * p_d AS p_d FROM m, range(0, 51) r(a)) SELECT round(alpha, 2) AS alpha, round(avg((power(p_h - (y = 'H')::INT, 2) + power(p_h + p_d - (y = 'H')::INT - (y = 'D')::INT, 2)) / 2), 6) AS rps FROM g GROUP BY 1")
def EV11_market_blend(spark, d):
    """The score of every blend of forecast and market from 0 to 1 (EV10, EV11, JN16); the grid is 51 values in each row."""
    m = with_market(predictions(spark, d)).withColumn("alpha", F.explode(F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: i / 50.0)))
    mix = lambda x, y: F.col("alpha") * F.col(x) + (1 - F.col("alpha")) * F.col(y)
    return m.groupBy(F.round("alpha", 2).alias("alpha")).agg(F.round(F.avg(rps(mix("m_h", "p_h"), mix("m_d", "p_d"), F.col("y"))), 6).alias("rps"))


@query(f"WITH p AS ({PREDICTIONS_SQL}), {_MARKET}, b AS (SELECT season, y, {_PICK} AS side, odds_h, odds_d, odds_a, greatest(p_h - m_h, p_d - m_d, p_a - m_a) AS edge FROM m) SELECT season, count(*) AS bets, round(avg((side = y)::INT), 6) AS hit_rate, round(avg(CASE WHEN side = y THEN CASE side WHEN 'H' THEN odds_h WHEN 'D' THEN odds_d ELSE odds_a END - 1 ELSE -1 END), 6) AS roi, count_if(edge > 0.03) AS value_picks FROM b GROUP BY 1")
def EV14_flat_stakes(spark, d):
    """One unit on the most likely class of each match (EV14); how often the best edge is above 0.03 (EV13)."""
    side = pick(F.col("p_h"), F.col("p_d"), F.col("p_a"))
    b = with_market(predictions(spark, d)).withColumns({"side": side, "edge": F.greatest(*[F.col(f"p_{c}") - F.col(f"m_{c}") for c in "hda"])})
    price = F.when(F.col("side") == "H", F.col("odds_h")).when(F.col("side") == "D", F.col("odds_d")).otherwise(F.col("odds_a"))
    won = F.col("side") == F.col("y")
    return b.groupBy("season").agg(F.count(F.lit(1)).alias("bets"), F.round(F.avg(won.cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.when(won, price - 1).otherwise(-1)), 6).alias("roi"), F.count_if(F.col("edge") > 0.03).alias("value_picks"))


@query(P + ", q AS (SELECT greatest(p_h, 0.3) AS h, greatest(p_d, 0.3) AS d, greatest(p_a, 0.3) AS a, match_id FROM p) SELECT match_id, round(h / (h + d + a), 6) AS p_h, round(d / (h + d + a), 6) AS p_d, round(a / (h + d + a), 6) AS p_a FROM q")
def FN13_floor(spark, d):
    p = predictions(spark, d)
    return p.select("match_id", *[F.round(c, 6).alias(n) for c, n in zip(floored([F.col("p_h"), F.col("p_d"), F.col("p_a")], 0.3), ("p_h", "p_d", "p_a"))])


_B = 100
_DRAW = "('0x' || substr(md5(b || ':' || match_id), 1, 8))::BIGINT"
_LOSS = "(power({0}_h - (y = 'H')::INT, 2) + power({0}_h + {0}_d - (y = 'H')::INT - (y = 'D')::INT, 2)) / 2"
_DIFF = f"dif AS (SELECT match_id, {_LOSS.format('p')} - {_LOSS.format('m')} AS delta FROM m)"


@query(f"WITH p AS ({PREDICTIONS_SQL}), {_MARKET}, {_DIFF}, z AS (SELECT b, -ln(({_DRAW} % 1000003 + 1) / 1000004.0) AS wt, delta FROM dif, range({_B}) g(b)) SELECT b, round(sum(wt * delta) / sum(wt), 6) AS mean_difference FROM z GROUP BY b")
def ST2_bootstrap(spark, d):
    """Resampled mean loss differences between forecast and market, matches as clusters (ST1, ST2).

    Each resample weighs every match by an exponential variable from a hash of both (the Bayesian bootstrap), so no
    table of draws is joined and no match is numbered: a row is read once, weighed for each resample, and added up
    before any shuffle.
    """
    m = with_market(predictions(spark, d))
    loss = lambda h, dr: rps(F.col(h), F.col(dr), F.col("y"))
    rows = m.select("match_id", (loss("p_h", "p_d") - loss("m_h", "m_d")).alias("delta")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(_B - 1))))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "b", "match_id")), 1, 8), 16, 10).cast("long") % 1000003
    z = rows.withColumn("wt", -F.ln((h + 1) / 1000004.0))
    return z.groupBy("b").agg(F.round(F.sum(F.col("wt") * F.col("delta")) / F.sum("wt"), 6).alias("mean_difference"))


@query(f"WITH p AS ({PREDICTIONS_SQL}), {_MARKET}, t AS (SELECT league, round((p_h - m_h), 9) AS x FROM m WHERE round(p_h - m_h, 9) <> 0), r AS (SELECT league, x, rank() OVER (PARTITION BY league ORDER BY abs(x)) + (count(*) OVER (PARTITION BY league, abs(x)) - 1) / 2.0 AS k FROM t) SELECT league, count(*) AS n, sum(CASE WHEN x > 0 THEN k ELSE 0 END) AS w_plus, sum(CASE WHEN x < 0 THEN k ELSE 0 END) AS w_minus FROM r GROUP BY 1")
def ST5_signed_ranks(spark, d):
    """Wilcoxon sums of average ranks, zeros dropped, by league."""
    t = with_market(predictions(spark, d)).select("league", F.round(F.col("p_h") - F.col("m_h"), 9).alias("x")).where("x <> 0")
    w = Window.partitionBy("league")
    k = F.rank().over(w.orderBy(F.abs("x"))) + (F.count(F.lit(1)).over(Window.partitionBy("league", F.abs("x"))) - 1) / 2.0
    return t.withColumn("k", k).groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("x") > 0, F.col("k")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("x") < 0, F.col("k")).otherwise(0.0)).alias("w_minus"))


@query("WITH t AS (SELECT l_returnflag || l_linestatus AS model, count(*) AS n, avg(l_tax) AS p FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, model) AS k, count(*) OVER () AS m FROM t) SELECT model, round(p, 9) AS p, round(least(1, max((m - k + 1) * p) OVER (ORDER BY k)), 9) AS adjusted FROM r")
def WN13_holm(spark, d):
    """Holm's step-down over a few hypotheses (WN13, ST6)."""
    t = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("model")).agg(F.avg("l_tax").alias("p"))
    w = Window.partitionBy(F.lit(0)).orderBy("p", "model")  # a row for each hypothesis
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    t = t.withColumn("up", (m - F.row_number().over(w) + 1) * F.col("p"))
    return t.select("model", F.round("p", 9).alias("p"), F.round(F.least(F.lit(1.0), F.max("up").over(w.rowsBetween(Window.unboundedPreceding, 0))), 9).alias("adjusted"))


@query(f"WITH f AS ({FIXTURES_SQL}), m AS (SELECT median(odds_h) AS mid FROM f WHERE season < 1996), s AS (SELECT avg(coalesce(odds_h, mid)) AS mu, stddev_pop(coalesce(odds_h, mid)) AS sd FROM f, m WHERE season < 1996), c AS (SELECT {RES} AS y, count(*) AS n, (SELECT count(*) FROM f WHERE season < 1996) AS total FROM f WHERE season < 1996 GROUP BY 1) SELECT match_id, round((coalesce(odds_h, mid) - mu) / sd, 6) AS z, round(total / (3.0 * n), 6) AS weight, league = 1 AS league_1, league = 2 AS league_2 FROM f JOIN c ON c.y = {RES}, m, s")
def PR2_prepare(spark, d):
    """Median, mean and deviation of the training seasons only (PR1, PR2), one-hot leagues (PR3), balanced class weights (PR12)."""
    f = fixtures(spark, d).withColumn("y", result("home_score", "away_score"))
    train = f.where("season < 1996")
    mid = train.agg(F.median("odds_h")).first()[0]
    x = F.coalesce("odds_h", F.lit(mid))
    mu, sd, total = train.agg(F.avg(x), F.stddev_pop(x), F.count(F.lit(1))).first()
    c = train.groupBy("y").agg(F.round(F.lit(total) / (3.0 * F.count(F.lit(1))), 6).alias("weight"))
    return f.join(F.broadcast(c), "y").select("match_id", F.round((x - mu) / sd, 6).alias("z"), "weight", (F.col("league") == 1).alias("league_1"), (F.col("league") == 2).alias("league_2"))


@query(FX + "SELECT match_id, ('0x' || substr(md5(match_id::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM f")
def PR5_folds(spark, d):
    """Whole matches into folds by a hash (PR5, PR6)."""
    return fixtures(spark, d).select("match_id", (F.conv(F.substring(F.md5(F.col("match_id").cast("string")), 1, 8), 16, 10).cast("long") % 5).alias("fold"))


@query()
def ML4_multinomial_logit(spark, d):
    """A multinomial logit on pre-match form and ratings, fitted on seasons before 1996; test probabilities (ML4, PR4, FN19)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    f = fixtures(spark, d)
    y = F.when(F.col("home_score") > F.col("away_score"), 0.0).when(F.col("home_score") == F.col("away_score"), 1.0).otherwise(2.0)
    x = ["diff_form_points", "diff_venue_points", "diff_form_gf", "elo_expected_home", "pi_expected_gd"]
    data = f.select("match_id", "season", y.alias("label")).join(prematch(f), "match_id").join(rate(f), "match_id").na.fill(0.0, x)
    data = VectorAssembler(inputCols=x, outputCol="features").transform(data.select("match_id", "season", "label", *[F.col(c).cast("double") for c in x])).persist()
    model = LogisticRegression(regParam=0.01, maxIter=30, family="multinomial").fit(data.where("season < 1996"))
    p = vector_to_array("probability")
    return model.transform(data.where("season >= 1996")).select("match_id", *[F.round(p[i], 6).alias(n) for i, n in enumerate(("p_h", "p_d", "p_a"))])


@query("SELECT match_id, CAST(t AS INT) AS t, count_if(day(ts) - 1 <= t) AS events, count_if(day(ts) - 1 <= t AND event_type = 'purchase') AS purchases FROM (SELECT user_id AS match_id, ts, event_type FROM events), range(0, 31, 5) g(t) GROUP BY 1, 2")
def ES10_stream_prefix(spark, d):
    """Prefix counts kept as events arrive; each match's last rows equal the batch result."""
    return live.drained(live.prefix_state(live.read_events(spark, d)), "update").groupBy("match_id", "t").agg(F.max("events").alias("events"), F.max("purchases").alias("purchases"))


@query("SELECT cast(date_trunc('day', ts) AS date) - k::INT AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, range(2) g(k) GROUP BY 1, 2")
def ES11_stream_windows(spark, d):
    """Sliding windows of two days over the stream, each event once."""
    w = live.drained(live.sliding_counts(live.read_events(spark, d)), "complete")
    return w.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", F.round(F.col("total").cast("double"), 2).alias("total"))
