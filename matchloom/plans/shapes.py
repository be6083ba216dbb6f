"""Column contracts, lookups, parsing, orders and reports over the fixtures, their events and forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.scores import result, rps
from matchloom.operators import temporal, windows
from matchloom.operators.columns import reindex
from matchloom.plans.forecasting import FP7_prematch_features, FP13_inplay_features, ST2_bootstrap, _FORM, _LOSS, _MARKET, LONG, prematch, team_rows, with_market
from matchloom.plans.registry import SQL, query
from matchloom.plans.relational import ER2_resolve
from matchloom.sources.views import EVENTS_SQL, FIXTURES_SQL, PREDICTIONS_SQL, appearances, dated_ratings, fixtures, match_events, parts, predictions, table

FX = f"WITH f AS ({FIXTURES_SQL}) "
RES = "CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END"


@query(FX + "SELECT match_id AS id, match_date AS date, cast(NULL AS VARCHAR) AS venue, odds_h FROM f")
def PF1_contract(spark, d):
    """Renamed, then brought to the columns of a contract: missing ones null, others gone."""
    f = fixtures(spark, d).withColumnsRenamed({"match_id": "id", "match_date": "date"})
    return reindex(f, {"id": "bigint", "date": "date", "venue": "string", "odds_h": "double"})


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN 'GK' WHEN p_size <= 4 THEN 'DEF' WHEN p_size <= 8 THEN 'MID' WHEN p_size > 8 THEN 'ATT' ELSE 'MID' END AS line FROM part")
def PF12_lines(spark, d):
    """A line from a place in the formation; no place counts as midfield."""
    k = F.col("p_size")
    line = F.when(k == 1, "GK").when(k <= 4, "DEF").when(k <= 8, "MID").when(k > 8, "ATT").otherwise("MID")
    return table(spark, d, "part").select("p_partkey", line.alias("line"))


@query("SELECT p_partkey, CASE trim(split_part(replace(p_name, ' ', ', '), ',', 1)) WHEN 'small' THEN 'GK' WHEN 'red' THEN 'DEF' WHEN 'blue' THEN 'ATT' ELSE 'MID' END AS bucket FROM part")
def PF13_first_position(spark, d):
    """The first element of a comma list to a bucket, MID if unknown."""
    first = F.trim(F.split(F.replace("p_name", F.lit(" "), F.lit(", ")), ",")[0])
    bucket = F.when(first == "small", "GK").when(first == "red", "DEF").when(first == "blue", "ATT").otherwise("MID")
    return table(spark, d, "part").select("p_partkey", bucket.alias("bucket"))


@query(FX + ", n AS (SELECT league, season + 1 AS season, home_team_id, count(*) AS n FROM f GROUP BY ALL) SELECT match_id, n AS last_season FROM f LEFT JOIN n USING (league, season, home_team_id)")
def JN9_lookup(spark, d):
    """A lookup by three keys: the home team's home matches of the season before, null on a miss."""
    f, keys = fixtures(spark, d), ["league", "season", "home_team_id"]
    n = f.groupBy("league", (F.col("season") + 1).alias("season"), "home_team_id").agg(F.count(F.lit(1)).alias("last_season"))
    return f.select("match_id", *keys).join(n, keys, "left").select("match_id", "last_season")


_EVEN = "(power(1 / 3.0 - (y = 'H')::INT, 2) + power(2 / 3.0 - (y = 'H')::INT - (y = 'D')::INT, 2)) / 2"
_LONG = f"WITH p AS ({PREDICTIONS_SQL}), {_MARKET}, l AS (SELECT match_id, league, unnest(['form', 'market', 'dummy']) AS model, unnest([{_LOSS.format('p')}, {_LOSS.format('m')}, {_EVEN}]) AS loss FROM m) "


def losses(spark, d):
    """(match_id, league, model, loss) of three models on the matches that all of them forecast."""
    y, third = F.col("y"), F.lit(1 / 3)
    of = {"form": rps(F.col("p_h"), F.col("p_d"), y), "market": rps(F.col("m_h"), F.col("m_d"), y), "dummy": rps(third, third, y)}
    return with_market(predictions(spark, d)).select("match_id", "league", F.explode(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v)])).alias("model", "loss"))


@query(_LONG + "SELECT a.model AS a, b.model AS b, count(*) AS n, round(avg(a.loss - b.loss), 6) AS difference, round(avg((round(a.loss, 9) < round(b.loss, 9))::INT), 6) AS share_better FROM l a JOIN l b ON a.match_id = b.match_id AND a.model < b.model GROUP BY 1, 2")
def JN14_model_pairs(spark, d):
    """Each pair of models on common matches: the mean difference and how often the first is better. A match has one row a model."""
    by = losses(spark, d).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("model", "loss"))).alias("m"))  # three
    pair = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["model"] > a["model"]), lambda b: F.struct(a["model"].alias("a"), b["model"].alias("b"), a["loss"].alias("x"), b["loss"].alias("y")))))
    better = (F.round("x", 9) < F.round("y", 9)).cast("int")
    return by.select(F.inline(pair)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x") - F.col("y")), 6).alias("difference"), F.round(F.avg(better), 6).alias("share_better"))


@query(f"SELECT round(quantile_cont(mean_difference, 0.025), 6) AS low, round(quantile_cont(mean_difference, 0.975), 6) AS high, least(1.0, 2 * least(avg((mean_difference <= 0)::INT), avg((mean_difference >= 0)::INT))) AS p FROM ({SQL['ST2_bootstrap']})")
def ST3_sign_test(spark, d):
    """The interval of the resampled means, and twice the smaller share of their signs."""
    m = F.col("mean_difference")
    low, high = (F.round(F.percentile(m, q), 6) for q in (0.025, 0.975))
    share = lambda c: F.avg(c.cast("int"))
    return ST2_bootstrap(spark, d).agg(low.alias("low"), high.alias("high"), F.least(F.lit(1.0), 2 * F.least(share(m <= 0), share(m >= 0))).alias("p"))


_GRID = f"g AS (SELECT DISTINCT match_id, CAST(t AS INT) AS t FROM ({EVENTS_SQL}) e, range(0, 31, 5) r(t))"


def frozen(spark, d):
    """Every snapshot of a match with its one forecast from before the start, null where there is none."""
    grid = table(spark, d, "events").select(F.col("user_id").alias("match_id")).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(30), F.lit(5))))
    return grid.join(predictions(spark, d).select("match_id", "p_h", "p_d", "p_a"), "match_id", "left")


@query(f"WITH p AS ({PREDICTIONS_SQL}), {_GRID} SELECT match_id, t, round(p_h, 6) AS p_h, p_h IS NOT NULL AS covered FROM g LEFT JOIN p USING (match_id)")
def JN15_frozen_row(spark, d):
    return frozen(spark, d).select("match_id", "t", F.round("p_h", 6).alias("p_h"), F.col("p_h").isNotNull().alias("covered"))


@query(f"WITH p AS ({PREDICTIONS_SQL}), {_GRID} SELECT match_id, count(*) AS n, max(p_h) - min(p_h) < 1e-9 AS flat FROM g JOIN p USING (match_id) GROUP BY 1")
def EX14_flat_reference(spark, d):
    """A frozen forecast does not move over the minutes."""
    return frozen(spark, d).where("p_h IS NOT NULL").groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), (F.max("p_h") - F.min("p_h") < 1e-9).alias("flat"))


_RATED = "r AS (SELECT l_partkey AS player, cast(l_shipdate AS date) AS dt, max(l_quantity) AS overall FROM lineitem GROUP BY 1, 2)"
_SQUADS = f"""{_RATED}, q AS (SELECT DISTINCT s_nationkey AS team, l_partkey AS player, cast(date_trunc('month', l_shipdate) AS date) AS m FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
 b AS (SELECT DISTINCT team, player, cast(m + to_months(k::INT) AS date) AS month FROM q, range(1, 4) g(k)), j AS (SELECT b.*, r.overall FROM b ASOF LEFT JOIN r ON b.player = r.player AND b.month > r.dt),
 s AS (SELECT team, month, round(avg(overall), 6) AS squad_mean, max(overall) AS squad_best, count(*) AS squad_size FROM j GROUP BY 1, 2)"""
_SIDES = f"""{_SQUADS}, h AS (SELECT f.match_id, s.squad_mean, s.squad_best, s.squad_size FROM f ASOF LEFT JOIN s ON f.home_team_id = s.team AND f.match_date > s.month),
 a AS (SELECT f.match_id, s.squad_mean, s.squad_best, s.squad_size FROM f ASOF LEFT JOIN s ON f.away_team_id = s.team AND f.match_date > s.month)"""
_BOTH = ", ".join(f"h.{c} AS home_{c}, a.{c} AS away_{c}" for c in ("squad_mean", "squad_best", "squad_size"))


def squads(spark, d):
    """ES7 + JN8 + AG12: a team's players of the last three months with their ratings before the month, by team and month."""
    lines = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("player"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("m"))
    n = parts(spark, d, "lineitem", 4)  # three months of each row, and its rating
    teams = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("team"))
    seen = lines.join(teams, "l_suppkey").select("team", "player", "m").repartition(n, "player").distinct()
    roster = seen.select("team", "player", F.explode(F.expr("sequence(add_months(m, 1), add_months(m, 3), interval 1 month)")).alias("month")).distinct()
    rated = temporal.asof_join(roster, dated_ratings(spark, d), "player", "month", "effective_date", "overall", n)
    return rated.groupBy("team", "month").agg(F.round(F.avg("overall"), 6).alias("squad_mean"), F.max("overall").alias("squad_best"), F.count(F.lit(1)).alias("squad_size"))


def squad_sides(f, snapshots):
    """ES8: each side of a match with its team's latest snapshot strictly before it; both sides in one as-of join."""
    held = F.struct("squad_mean", "squad_best", "squad_size").alias("squad")
    both = f.select("match_id", "match_date", F.inline(F.array(*[F.struct(F.lit(v).alias("venue"), F.col(f"{v}_team_id").alias("team")) for v in ("home", "away")])))
    j = temporal.asof_join(both, snapshots.select("team", "month", held), "team", "match_date", "month", "squad")
    return windows.home_away(j.select("match_id", "venue", "squad.*"), "match_id", ["squad_mean", "squad_best", "squad_size"])


@query(f"WITH {_SQUADS} SELECT * FROM s")
def FP11_squads(spark, d):
    return squads(spark, d)


@query(FX + f", {_SIDES} SELECT match_id, {_BOTH} FROM h JOIN a USING (match_id)")
def ES8_team_strength(spark, d):
    """The strength of both sides of a match (ES8), as attached to its snapshots (JN17)."""
    out = squad_sides(fixtures(spark, d), squads(spark, d))
    return out.select("match_id", *[f"{v}_{c}" for v in ("home", "away") for c in ("squad_mean", "squad_best", "squad_size")])


@query(f"SELECT x.*, z.* EXCLUDE (match_id) FROM ({SQL['FP7_prematch_features']}) x JOIN ({FX}, {_SIDES} SELECT match_id, {_BOTH} FROM h JOIN a USING (match_id)) z ON x.match_id = z.match_id")
def FP8_extended_features(spark, d):
    """Form and squads of a match in one row; each part has one row a match."""
    return FP7_prematch_features(spark, d).join(ES8_team_strength(spark, d), "match_id")


@query(f"SELECT match_id, min(t) FILTER (WHERE diff_events < 0) AS crossover FROM ({SQL['FP13_inplay_features']}) GROUP BY 1")
def WN16_crossover(spark, d):
    """The first minute at which one series is below the other; null if it never is."""
    return FP13_inplay_features(spark, d).groupBy("match_id").agg(F.min(F.when(F.col("diff_events") < 0, F.col("t"))).alias("crossover"))


@query(f"SELECT x.match_id, round(any_value(p_h), 6) AS p_h, string_agg(t || ':' || diff_events, ',' ORDER BY t) AS replay FROM ({SQL['FP13_inplay_features']}) x LEFT JOIN ({PREDICTIONS_SQL}) p ON x.match_id = p.match_id GROUP BY 1")
def ES9_replay(spark, d):
    """A match's snapshots in order of time, seven at most, with its forecast."""
    at = F.array_sort(F.collect_list(F.struct("t", "diff_events")))
    seen = FP13_inplay_features(spark, d).groupBy("match_id").agg(F.array_join(F.transform(at, lambda s: F.concat_ws(":", s["t"].cast("string"), s["diff_events"].cast("string"))), ",").alias("replay"))
    return seen.join(predictions(spark, d).select("match_id", F.round("p_h", 6).alias("p_h")), "match_id", "left")


@query(f"""WITH e AS ({EVENTS_SQL}), v AS (SELECT *, max(minute) OVER (PARTITION BY match_id ORDER BY idx) AS eff FROM e), {_GRID}
 SELECT g.match_id, t, count(*) FILTER (WHERE eff <= t) AS n_in, true AS holds FROM g JOIN v USING (match_id) GROUP BY 1, 2""")
def ES5_prefix_holds(spark, d):
    """Snapshots hold all events up to their minute and none after it: counts from the snapshots against clocks from the events."""
    e = match_events(spark, d).withColumn("eff", windows.running_max("minute", ["match_id"], ["idx"]))
    held = temporal.prefix_snapshots(match_events(spark, d), 5, 30, 10).groupBy("match_id", "t").agg(F.sum("events").alias("n_in"))
    minutes = e.groupBy("match_id", "eff").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(30), F.lit(5))))
    inside = F.col("eff") <= F.col("t")
    clock = minutes.groupBy("match_id", "t").agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("m"), F.max(F.when(inside, F.col("eff"))).alias("last"), F.min(F.when(~inside, F.col("eff"))).alias("next"))
    fine = (F.col("n_in") == F.col("m")) & F.coalesce(F.col("last") <= F.col("t"), F.lit(True)) & F.coalesce(F.col("next") > F.col("t"), F.lit(True))
    return held.join(clock, ["match_id", "t"]).select("match_id", "t", "n_in", fine.alias("holds"))


@query(FX + "SELECT match_id, season, home_score, row_number() OVER (PARTITION BY season ORDER BY home_score DESC, match_id) AS place FROM f")
def SO1_sorted(spark, d):
    """Seasons upwards, scores downwards, ids upwards."""
    w = Window.partitionBy("season").orderBy(F.desc("home_score"), "match_id")
    return fixtures(spark, d).select("match_id", "season", "home_score", F.row_number().over(w).alias("place")).orderBy("season", F.desc("home_score"), "match_id")


@query("SELECT o_orderpriority AS task, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS place, count(*) AS n FROM orders GROUP BY 1, 2")
def SO3_mapped_rank(spark, d):
    """Tasks in an order given by a map, the others last."""
    place = F.when(F.col("o_orderpriority") == "5-LOW", 1).when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(3)
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task"), place.alias("place")).agg(F.count(F.lit(1)).alias("n")).orderBy("place", "task")


@query(_LONG + "SELECT league, model, round(s, 6) AS score FROM (SELECT league, model, avg(loss) AS s FROM l WHERE model <> 'dummy' AND loss IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY league ORDER BY s, model) = 1")
def SO5_leaderboard(spark, d):
    """The best model of each league, dummies and missing scores aside."""
    s = losses(spark, d).where("model <> 'dummy' AND loss IS NOT NULL").groupBy("league", "model").agg(F.avg("loss").alias("s"))
    return windows.top(s, ["league"], [F.col("s"), F.col("model")]).select("league", "model", F.round("s", 6).alias("score"))


@query(_LONG + "SELECT count(*) AS models, count(DISTINCT n) = 1 AS holds FROM (SELECT model, count(*) AS n FROM l GROUP BY 1)")
def EX13_equal_budget(spark, d):
    """All models were scored equally often."""
    return losses(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("models"), (F.count_distinct("n") == 1).alias("holds"))


@query("SELECT p_partkey, contains(p_name, 'ring') AS has_ring, ends_with(p_name, 'widget') AS is_widget, starts_with(p_name, 'red') AS is_red, split_part(p_name, ' ', 1) AS first, 'part:' || p_partkey AS key FROM part")
def FN5_strings(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", n.contains("ring").alias("has_ring"), n.endswith("widget").alias("is_widget"), n.startswith("red").alias("is_red"), F.split(n, " ")[0].alias("first"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL ELSE cast(o_orderdate AS date) END AS parsed FROM orders")
def FN6_mixed_dates(spark, d):
    """Day-first dates with years of two or four digits; years of two digits lie in 1969 to 2068, and others are null."""
    day = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yy")).when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("soon")
    short = F.try_to_timestamp("s", F.lit("dd/MM/yy")).cast("date")
    short = F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short)
    return table(spark, d, "orders").select("o_orderkey", day.alias("s")).select("o_orderkey", F.coalesce(short, F.try_to_timestamp("s", F.lit("dd/MM/yyyy")).cast("date")).alias("parsed"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN NULL ELSE l_linenumber * 60 + cast(l_quantity AS INT) END AS seconds FROM lineitem")
def FN7_durations(spark, d):
    """minutes:seconds to seconds; null where either is no number."""
    shown = F.when(F.col("l_returnflag") == "N", "n/a").otherwise(F.concat_ws(":", F.col("l_linenumber").cast("string"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0")))
    part = F.split("s", ":")
    return table(spark, d, "lineitem").withColumn("s", shown).select("l_orderkey", "l_linenumber", (F.get(part, F.lit(0)).try_cast("int") * 60 + F.get(part, F.lit(1)).try_cast("int")).alias("seconds"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) AS quarter FROM lineitem")
def FN10_half_even(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4, 0).alias("quarter"))


@query(FX + "SELECT match_id, unnest([1, 2]) AS slot, unnest([home_team_id, away_team_id]) AS team_id, unnest([home_score, away_score]) AS score FROM f")
def FN18_wide_to_long(spark, d):
    """Numbered columns of two kinds to a row for each number."""
    slots = F.arrays_zip(F.array("home_team_id", "away_team_id").alias("team_id"), F.array("home_score", "away_score").alias("score"))
    return fixtures(spark, d).select("match_id", F.posexplode(slots)).select("match_id", (F.col("pos") + 1).alias("slot"), "col.team_id", "col.score")


@query(FX + f"SELECT match_id, ({RES} = 'H')::INT AS is_h, ({RES} = 'D')::INT AS is_d, ({RES} = 'A')::INT AS is_a FROM f")
def FN20_one_hot(spark, d):
    y = result("home_score", "away_score")
    return fixtures(spark, d).select("match_id", *[(y == k).cast("int").alias(f"is_{k.lower()}") for k in "HDA"])


@query(f"SELECT method, count(*) AS n, count(*) FILTER (WHERE method = 'fuzzy' AND ratio < 0.8) AS doubtful FROM ({SQL['ER2_resolve']}) GROUP BY 1")
def ER8_alias_audit(spark, d):
    """How names were resolved, and how many of them with little in common."""
    return ER2_resolve(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("method") == "fuzzy") & (F.col("ratio") < 0.8)).alias("doubtful"))


@query(FX + "SELECT match_date, count(*) AS n, 1 AS splits, true AS holds FROM f GROUP BY 1")
def EX5_one_split(spark, d):
    """Matches of a date are in one split."""
    s = temporal.date_split(fixtures(spark, d), "match_date").groupBy("match_date").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").cast("int").alias("splits"))
    return s.withColumn("holds", F.col("splits") == 1)


@query(f"WITH f AS ({FIXTURES_SQL}), {LONG}, {_FORM} SELECT count(*) AS n_first, count(*) FILTER (WHERE coalesce(form_points, form_gf, form_ga, h2h_points) IS NOT NULL) AS violations FROM q WHERE played_prior = 0")
def EX6_prior_only(spark, d):
    """A team's first match has no form."""
    order = ["match_date", "match_id"]
    t = windows.prior_mean(team_rows(fixtures(spark, d)), ["team"], order, {"form_points": "points", "form_gf": "gf"}, 5)
    t = windows.prior_mean(t, ["team", "opp"], order, {"h2h_points": "points"}, 3)
    first = windows.top(t, ["team"], [F.col(c) for c in order])
    return first.agg(F.count(F.lit(1)).alias("n_first"), F.count_if(F.coalesce("form_points", "form_gf", "h2h_points").isNotNull()).alias("violations"))


@query(f"WITH {_RATED}, l AS (SELECT DISTINCT l_orderkey, l_partkey AS player, cast(o_orderdate AS date) AS match_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT count(*) AS slots, count(r.dt) AS rated, count(*) FILTER (WHERE r.dt >= l.match_date) AS violations FROM l ASOF LEFT JOIN r ON l.player = r.player AND l.match_date > r.dt")
def EX7_strictly_before(spark, d):
    """A rating joined to a match is never of its day or later."""
    dates = dated_ratings(spark, d).select("player", "effective_date", F.col("effective_date").alias("dt"))
    j = temporal.asof_join(appearances(spark, d), dates, "player", "match_date", "effective_date", "dt", parts(spark, d, "lineitem", 2))
    return j.agg(F.count(F.lit(1)).alias("slots"), F.count("dt").alias("rated"), F.count_if(F.col("dt") >= F.col("match_date")).alias("violations"))


@query(FX + "SELECT league, season, count(*) AS n, count(*) - count(DISTINCT (match_date, home_team_id, away_team_id)) AS repeated, count(*) BETWEEN 50 AND 100 AS in_band FROM f GROUP BY 1, 2")
def EX11_cells(spark, d):
    """Fixtures that a cell lists twice, and whether its size is as expected."""
    per = fixtures(spark, d).groupBy("league", "season", "match_date", "home_team_id", "away_team_id").agg(F.count(F.lit(1)).alias("k"))
    cell = per.groupBy("league", "season").agg(F.sum("k").alias("n"), F.sum(F.col("k") - 1).alias("repeated"))
    return cell.withColumn("in_band", F.col("n").between(50, 100))


@query("SELECT o_orderkey, round(o_totalprice - total, 2) AS gap, coalesce(abs(o_totalprice - total) < 1, false) AS agrees FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def EX12_reproduced(spark, d):
    """Stored totals against those added up again: a report, not a failure."""
    total = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("total"))
    gap = F.col("o_totalprice") - F.col("total")
    return table(spark, d, "orders").join(total, "o_orderkey", "left").select("o_orderkey", F.round(gap, 2).alias("gap"), F.coalesce(F.abs(gap) < 1, F.lit(False)).alias("agrees"))


@query(FX + "SELECT count(*) AS n, 0 AS changed FROM f")
def EX15_tamper(spark, d):
    """Another score in each league's last match changes no features: its own come from before it, and no match comes after."""
    f = fixtures(spark, d)
    last = windows.top(f, ["league"], [F.desc("match_date"), F.desc("match_id")]).select("match_id", F.lit(9).alias("_more"))  # one a league
    other = f.join(last, "match_id", "left").withColumn("home_score", F.col("home_score") + F.coalesce("_more", F.lit(0))).drop("_more")
    digest = lambda x, c: x.select("match_id", F.xxhash64(*sorted(k for k in x.columns if k != "match_id")).alias(c))
    both = digest(prematch(f), "a").join(digest(prematch(other), "b"), "match_id", "full")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).cast("int").alias("changed"))


@query(FX + f", t AS (SELECT {RES} AS y, home_score - away_score AS margin FROM f WHERE season <= 1998) SELECT y, round(count(*) / (SELECT count(*) FROM t), 6) AS share, (SELECT round(avg(margin), 6) FROM t) AS mean_margin FROM t GROUP BY 1")
def ML1_dummy(spark, d):
    """The training seasons' class shares and mean margin."""
    t = fixtures(spark, d).where("season <= 1998").select(result("home_score", "away_score").alias("y"), (F.col("home_score") - F.col("away_score")).alias("margin"))
    w = Window.partitionBy(F.lit(0))  # three rows
    c = t.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("margin").alias("s"))
    n = F.sum("n").over(w)
    return c.select("y", F.round(F.col("n") / n, 6).alias("share"), F.round(F.sum("s").over(w) / n, 6).alias("mean_margin"))
