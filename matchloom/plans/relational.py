"""Projections, joins, aggregates, windows, set operations and functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.scores import clip, de_vig, ratio, result
from matchloom.functions.text import normalise, token_similarity
from matchloom.operators import temporal, windows
from matchloom.operators.contracts import keyed_join
from matchloom.plans.registry import query
from matchloom.sources.views import EVENTS_SQL, FIXTURES_SQL, appearances, dated_ratings, fixtures, match_events, parts, table

FX = f"WITH f AS ({FIXTURES_SQL}) "
EV = f"WITH e AS ({EVENTS_SQL}) "
RES = "CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END"


@query(FX + f"SELECT match_id, {RES} AS result, home_score - away_score AS margin_raw, greatest(-2, least(2, home_score - away_score)) AS margin, CASE {RES} WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS points FROM f")
def PF2_labels(spark, d):
    """PF2 result, PF3 clip, PF4 points."""
    y = result("home_score", "away_score")
    raw = F.col("home_score") - F.col("away_score")
    return fixtures(spark, d).select("match_id", y.alias("result"), raw.alias("margin_raw"), clip(raw, -2, 2).cast("long").alias("margin"), F.when(y == "H", 3).when(y == "D", 1).otherwise(0).alias("points"))


@query(FX + "SELECT 'fixtures' AS source, match_id, CASE WHEN odds_h IS NULL THEN 'no home price' WHEN odds_d IS NULL THEN 'no draw price' ELSE 'no away price' END AS reason FROM f WHERE odds_h IS NULL OR odds_d IS NULL OR odds_a IS NULL")
def PF5_drop_log(spark, d):
    """Rejected rows with the first reason that holds; the kept rows are those without one."""
    why = F.when(F.col("odds_h").isNull(), "no home price").when(F.col("odds_d").isNull(), "no draw price").when(F.col("odds_a").isNull(), "no away price")
    return fixtures(spark, d).withColumn("reason", why).where("reason IS NOT NULL").select(F.lit("fixtures").alias("source"), "match_id", "reason")


@query(FX + "SELECT match_id, odds_h, odds_d, odds_a FROM f WHERE odds_h IS NOT NULL AND odds_d IS NOT NULL AND odds_a IS NOT NULL")
def PF6_complete_rows(spark, d):
    return fixtures(spark, d).select("match_id", "odds_h", "odds_d", "odds_a").na.drop("any")


@query(FX + "SELECT season, league, n, CASE WHEN n >= 80 THEN 'core' WHEN n >= 60 THEN 'extended' ELSE 'out_of_scope' END AS category FROM (SELECT season, league, count(*) AS n FROM f GROUP BY ALL) WHERE n >= 50")
def PF8_categories(spark, d):
    """PF8 ordered rules after PF16: seasons of a league with too few matches go."""
    n = fixtures(spark, d).groupBy("season", "league").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")
    return n.withColumn("category", F.when(F.col("n") >= 80, "core").when(F.col("n") >= 60, "extended").otherwise("out_of_scope"))


@query(EV + "SELECT CASE WHEN minute < 10 THEN 'early' WHEN minute < 20 THEN 'middle' ELSE 'late' END AS phase, count(*) AS n, count_if(type IN ('view', 'click')) AS on_ball FROM e GROUP BY 1")
def PF11_phases(spark, d):
    """PF11 half-open phases, PF7 membership."""
    phase = F.when(F.col("minute") < 10, "early").when(F.col("minute") < 20, "middle").otherwise("late")
    return match_events(spark, d).groupBy(phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type").isin("view", "click")).alias("on_ball"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k, try_cast(substr(event_type, 1, 1) AS double) AS coerced, coalesce(value > 100, false) AS big FROM events")
def FN17_nested_fields(spark, d):
    """FN17 nested access, PF17 coercion to null, PF18 null to false."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.substring("event_type", 1, 1).try_cast("double").alias("coerced"), F.coalesce(F.col("value") > 100, F.lit(False)).alias("big"))


@query("SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def JN1_inner(spark, d):
    """An inner join that raises if the right key repeats (JN5, many to one)."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return keyed_join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, ["c_nationkey"], "inner", "many_to_one").select("c_custkey", "c_nationkey", "n_name")


@query("SELECT coalesce(h.k, a.k) AS k, n_home, n_away FROM (SELECT c_nationkey AS k, count(*) AS n_home FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1) h FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_away FROM supplier GROUP BY 1) a ON h.k = a.k")
def JN3_full(spark, d):
    h = table(spark, d, "customer").where("c_custkey % 3 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_home"))
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_away"))
    return h.join(a, "k", "full").select("k", "n_home", "n_away")


@query("SELECT o_orderkey, CASE WHEN e.user_id IS NULL THEN 'no events' ELSE 'matched' END AS outcome, n FROM orders LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON o_custkey = e.user_id")
def JN4_misses(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(e, "o_custkey", "left").select("o_orderkey", F.when(F.col("n").isNull(), "no events").otherwise("matched").alias("outcome"), "n")


@query(FX + "SELECT l.match_id, l.match_date, r.match_id AS other_id, abs(date_diff('day', l.match_date, r.match_date)) AS gap FROM f l LEFT JOIN f r ON l.home_team_id = r.away_team_id AND l.away_team_id = r.home_team_id AND abs(date_diff('day', l.match_date, r.match_date)) <= 3 QUALIFY row_number() OVER (PARTITION BY l.match_id ORDER BY gap NULLS LAST, r.match_id) = 1")
def JN7_tolerance(spark, d):
    """Each fixture with the nearest return fixture within 3 days (JN6 identity by teams, JN19 nearest in time)."""
    f = fixtures(spark, d)
    pair = lambda a, b: F.concat_ws("-", a, b)
    left = f.select("match_id", "match_date", pair("home_team_id", "away_team_id").alias("pair"))
    right = f.select(F.col("match_id").alias("other_id"), F.col("match_date").alias("r_match_date"), pair("away_team_id", "home_team_id").alias("pair"))
    return temporal.nearest_join(left, right, "pair", "match_date", 3, "match_id", "other_id").select("match_id", "match_date", "other_id", "gap")


_RATED = "(SELECT l_partkey AS player, cast(l_shipdate AS date) AS effective_date, max(l_quantity) AS overall FROM lineitem GROUP BY 1, 2)"


@query(f"SELECT l.l_orderkey, l.player, l.match_date, r.overall FROM (SELECT DISTINCT l_orderkey, l_partkey AS player, cast(o_orderdate AS date) AS match_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey) l ASOF LEFT JOIN {_RATED} r ON l.player = r.player AND l.match_date > r.effective_date")
def JN8_asof(spark, d):
    """The latest rating strictly before each match date."""
    n = parts(spark, d, "lineitem", 2)  # a row of each side
    return temporal.asof_join(appearances(spark, d), dated_ratings(spark, d), "player", "match_date", "effective_date", "overall", n).select("l_orderkey", "player", "match_date", "overall")


@query(FX + "SELECT match_id, CAST(t AS INT) AS t FROM f, range(0, 31, 5) g(t)")
def JN10_grid(spark, d):
    return fixtures(spark, d).select("match_id", F.explode(F.sequence(F.lit(0), F.lit(30), F.lit(5))).alias("t"))


@query("SELECT c_custkey, 'tagged' AS side FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL SELECT c_custkey, 'untagged' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)")
def JN12_semi_anti(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    tagged = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return c.join(tagged, "c_custkey", "left_semi").withColumn("side", F.lit("tagged")).union(c.join(tagged, "c_custkey", "left_anti").withColumn("side", F.lit("untagged")))


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_discount) AS low, max(l_discount) AS high, round(stddev_samp(l_quantity), 6) AS std, median(l_quantity) AS mid FROM lineitem GROUP BY 1")
def AG1_statistics(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_discount").alias("low"),
        F.max("l_discount").alias("high"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"), F.median("l_quantity").alias("mid"),
    )


@query(EV + """SELECT match_id, team_id, count(*) AS events, count_if(type = 'purchase') AS shots, count_if(type = 'purchase' AND value > 100) AS goals, round(coalesce(sum(CASE WHEN type = 'purchase' THEN shot_xg END), 0), 6) AS xg,
 count_if(type = 'purchase' AND x >= 102) AS shots_in_box, count_if(x >= 80) AS touches_attacking_third, count_if(type = 'signup') AS pressures,
 round(CASE WHEN count_if(type = 'signup') > 0 THEN count_if(type = 'signup' AND x >= 80) / count_if(type = 'signup') ELSE 0 END, 6) AS pressure_rate, count_if(type = 'error') AS fouls, round(avg(x), 6) AS mean_x FROM e GROUP BY 1, 2""")
def AG2_quantities(spark, d):
    """Conditional counts of an event table by match and team, one pass (AG3 ratios, AG7 goals, AG8 fouls)."""
    t, far = F.col("type"), F.col("x") >= 80
    shot, press = t == "purchase", t == "signup"
    return match_events(spark, d).groupBy("match_id", "team_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(shot).alias("shots"), F.count_if(shot & (F.col("value") > 100)).alias("goals"),
        F.round(F.coalesce(F.sum(F.when(shot, F.col("shot_xg"))), F.lit(0.0)), 6).alias("xg"), F.count_if(shot & (F.col("x") >= 102)).alias("shots_in_box"),
        F.count_if(far).alias("touches_attacking_third"), F.count_if(press).alias("pressures"),
        F.round(ratio(F.count_if(press & far), F.count_if(press)), 6).alias("pressure_rate"), F.count_if(t == "error").alias("fouls"), F.round(F.avg("x"), 6).alias("mean_x"),
    )


_OWN = "own AS (SELECT match_id, possession, team_id FROM (SELECT match_id, possession, team_id, count(*) AS n FROM e WHERE type IN ('view', 'click') AND team_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY match_id, possession ORDER BY n DESC, team_id) = 1)"


@query(f"WITH e AS ({EVENTS_SQL}), {_OWN} SELECT match_id, team_id, owned, round(owned / sum(owned) OVER (PARTITION BY match_id), 6) AS share FROM (SELECT match_id, team_id, count(*) AS owned FROM own GROUP BY ALL)")
def AG4_possession(spark, d):
    """The owner of each chain has most on-ball events, ties to the lower team (AG4); chains owned and their share (AG5)."""
    n = match_events(spark, d).where(F.col("type").isin("view", "click") & F.col("team_id").isNotNull()).groupBy("match_id", "possession", "team_id").agg(F.count(F.lit(1)).alias("n"))
    own = windows.top(n, ["match_id", "possession"], [F.desc("n"), F.col("team_id")])
    owned = own.groupBy("match_id", "team_id").agg(F.count(F.lit(1)).alias("owned"))
    return owned.withColumn("share", F.round(F.col("owned") / F.sum("owned").over(Window.partitionBy("match_id")), 6))


@query(f"WITH e AS ({EVENTS_SQL}), q AS (SELECT match_id, team_id, count(*) AS n, count_if(type = 'purchase') AS shots FROM e GROUP BY ALL) SELECT a.match_id, a.team_id, a.n, a.shots, b.n AS opp_n, b.shots AS opp_shots FROM q a LEFT JOIN q b ON a.match_id = b.match_id AND a.team_id <> b.team_id")
def AG6_opponent(spark, d):
    """A team's counts beside its opponent's, from one aggregation and a window over the two rows."""
    q = match_events(spark, d).groupBy("match_id", "team_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "purchase").alias("shots"))
    w = Window.partitionBy("match_id")
    return q.withColumns({f"opp_{c}": F.when(F.count(F.lit(1)).over(w) > 1, F.sum(c).over(w) - F.col(c)) for c in ("n", "shots")})


@query("SELECT o_custkey AS id, o_orderpriority AS name, n AS observations, variants FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS variants FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")
def AG10_canonical_names(spark, d):
    """The most frequent name of each id, ties by name, with its count and the number of names (AG11, ER1)."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("observations"))
    n = n.withColumn("variants", F.count(F.lit(1)).over(Window.partitionBy("id")))
    return windows.top(n, ["id"], [F.desc("observations"), F.col("name")])


@query("SELECT o_custkey, round(avg(p) FILTER (WHERE r <= 3), 4) AS best3, round(avg(p) FILTER (WHERE r <= 5), 4) AS best5, max(p) AS best, count(*) AS n FROM (SELECT o_custkey, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) GROUP BY 1")
def AG12_top_means(spark, d):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    mean = lambda k: F.round(F.avg(F.when(F.col("r") <= k, F.col("o_totalprice"))), 4)
    return table(spark, d, "orders").withColumn("r", r).groupBy("o_custkey").agg(mean(3).alias("best3"), mean(5).alias("best5"), F.max("o_totalprice").alias("best"), F.count(F.lit(1)).alias("n"))


@query(FX + ", b AS (SELECT match_id, unnest([odds_h, odds_h * 1.02, odds_h * 0.97]) AS h, unnest([odds_d, odds_d * 0.99, NULL]) AS d, unnest([odds_a, odds_a * 1.01, odds_a * 1.03]) AS a FROM f) SELECT match_id, round(median(h), 6) AS h, round(median(d), 6) AS d, round(median(a), 6) AS a FROM b WHERE h IS NOT NULL AND d IS NOT NULL AND a IS NOT NULL GROUP BY 1")
def AG13_median_odds(spark, d):
    """Median over bookmakers; a book without all three prices is left out first."""
    p = lambda x, y, z: F.struct((F.col("odds_h") * x).alias("h"), (F.col("odds_d") * y if y else F.lit(None).cast("double")).alias("d"), (F.col("odds_a") * z).alias("a"))
    books = fixtures(spark, d).select("match_id", F.inline(F.array(p(1.0, 1.0, 1.0), p(1.02, 0.99, 1.01), p(0.97, None, 1.03)))).na.drop()
    return books.groupBy("match_id").agg(*[F.round(F.median(c), 6).alias(c) for c in "hda"])


@query(FX + "SELECT coalesce(league::VARCHAR, 'ALL') AS league, count(*) AS matches, count(odds_h + odds_d + odds_a) AS priced, round(count(odds_h + odds_d + odds_a) / count(*), 4) AS coverage, bool_and(home_score >= 0) AS sound FROM f GROUP BY ROLLUP (league)")
def AG15_coverage(spark, d):
    """Coverage by league with a row for all (AG14, AG15), and a predicate on all rows (AG16)."""
    priced = F.count(F.col("odds_h") + F.col("odds_d") + F.col("odds_a"))
    r = fixtures(spark, d).rollup("league").agg(F.count(F.lit(1)).alias("matches"), priced.alias("priced"), F.round(priced / F.count(F.lit(1)), 4).alias("coverage"), F.every(F.col("home_score") >= 0).alias("sound"))
    return r.withColumn("league", F.coalesce(F.col("league").cast("string"), F.lit("ALL")))


@query(FX + f"SELECT league, round(count_if(y = 'H') / count(*), 6) AS H, round(count_if(y = 'D') / count(*), 6) AS D, round(count_if(y = 'A') / count(*), 6) AS A FROM (SELECT league, {RES} AS y FROM f) GROUP BY 1")
def AG17_outcome_shares(spark, d):
    y = fixtures(spark, d).select("league", result("home_score", "away_score").alias("y"))
    n = y.groupBy("league").pivot("y", ["H", "D", "A"]).count().na.fill(0)
    return n.select("league", *[F.round(F.col(c) / (F.col("H") + F.col("D") + F.col("A")), 6).alias(c) for c in "HDA"])


@query("SELECT l_returnflag, round(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 4) AS O, round(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 4) AS F FROM lineitem GROUP BY 1")
def AG18_pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.round(F.avg("l_extendedprice"), 4))


@query("SELECT o_custkey, min_by(o_orderkey, o_totalprice) AS cheapest, max_by(o_orderkey, o_totalprice) AS dearest FROM orders GROUP BY 1")
def AG20_arg_extremes(spark, d):
    """The cheapest and the dearest order of a customer, of those with key and price; of orders at one price that with the smallest key."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    at = lambda key: F.when(F.expr("o_totalprice IS NOT NULL AND o_orderkey IS NOT NULL"), F.struct("o_totalprice", key))
    return rows.groupBy("o_custkey").agg(F.min_by("o_orderkey", at("o_orderkey")).alias("cheapest"), F.max_by("o_orderkey", at(F.bitwise_not("o_orderkey"))).alias("dearest"))


@query(FX + "SELECT league, season, count(*) AS matches, (SELECT count(DISTINCT t) FROM (SELECT home_team_id AS t, league AS l, season AS s FROM f UNION ALL SELECT away_team_id, league, season FROM f) u WHERE u.l = g.league AND u.s = g.season) AS teams, min(match_date) AS first_date, max(match_date) AS last_date, round(avg((odds_h IS NOT NULL)::INT), 6) AS flagged FROM f g GROUP BY 1, 2")
def AG21_season_audit(spark, d):
    f = fixtures(spark, d)
    teams = f.select("league", "season", F.explode(F.array("home_team_id", "away_team_id")).alias("t")).groupBy("league", "season").agg(F.countDistinct("t").alias("teams"))
    n = f.groupBy("league", "season").agg(F.count(F.lit(1)).alias("matches"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"), F.round(F.avg(F.col("odds_h").isNotNull().cast("int")), 6).alias("flagged"))
    return n.join(teams, ["league", "season"])


@query(FX + " SELECT unnest(['odds_h', 'odds_d', 'odds_a']) AS field, unnest([count_if(odds_h IS NULL), count_if(odds_d IS NULL), count_if(odds_a IS NULL)]) AS affected_rows FROM f")
def AG22_quality_log(spark, d):
    n = fixtures(spark, d).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("odds_h", "odds_d", "odds_a")])
    return n.unpivot([], ["odds_h", "odds_d", "odds_a"], "field", "affected_rows")


@query(FX + "SELECT cast(date_trunc('week', match_date) AS date) AS week, league, count(*) AS matches FROM f GROUP BY 1, 2")
def AG23_weekly(spark, d):
    return fixtures(spark, d).groupBy(F.date_trunc("week", "match_date").cast("date").alias("week"), "league").agg(F.count(F.lit(1)).alias("matches"))


@query(FX + "SELECT league, round(quantile_cont(o, 0), 6) AS q0, round(quantile_cont(o, 0.25), 6) AS q1, round(quantile_cont(o, 0.5), 6) AS q2, round(quantile_cont(o, 0.75), 6) AS q3, round(quantile_cont(o, 1), 6) AS q4 FROM (SELECT league, odds_h AS o FROM f WHERE odds_h IS NOT NULL) GROUP BY 1")
def AG24_five_numbers(spark, d):
    q = F.percentile("odds_h", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    return fixtures(spark, d).where("odds_h IS NOT NULL").groupBy("league").agg(q.alias("q")).select("league", *[F.round(F.get("q", F.lit(i)), 6).alias(f"q{i}") for i in range(5)])


@query("SELECT l_returnflag, round(avg(abs(l_quantity - l_tax * 100)), 6) AS mae, round(sqrt(avg((l_quantity - l_tax * 100) ** 2)), 6) AS rmse, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope FROM lineitem GROUP BY 1")
def AG25_errors(spark, d):
    """Errors and correlation (AG25, EV7) and the slope of a power law (AG26)."""
    e = F.col("l_quantity") - F.col("l_tax") * 100
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"),
        F.round(F.regr_slope(F.ln("l_extendedprice"), F.ln("l_quantity")), 6).alias("slope"),
    )


_SPLIT = "r AS (SELECT match_date, row_number() OVER (ORDER BY match_date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT match_date FROM f)), s AS (SELECT match_date, CASE WHEN k <= trunc(n * 0.6) THEN 'train' WHEN k <= trunc(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM r)"


@query(f"WITH f AS ({FIXTURES_SQL}), {_SPLIT} SELECT split, count(*) AS n, min(match_date) AS first_date, max(match_date) AS last_date, count(DISTINCT league) AS leagues FROM f JOIN s USING (match_date) GROUP BY 1")
def WN11_date_split(spark, d):
    """Whole dates into splits (WN11, EX4), and their summary (AG27)."""
    return temporal.date_split(fixtures(spark, d), "match_date").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"), F.countDistinct("league").alias("leagues"))


@query(EV + "SELECT match_id, idx, max(minute) OVER (PARTITION BY match_id ORDER BY idx) AS effective_minute, idx <> row_number() OVER (PARTITION BY match_id ORDER BY minute, idx) AS moved FROM e")
def WN6_effective_minute(spark, d):
    """The repaired clock (WN6) and rows that another order moves (WN12, SO2)."""
    other = F.row_number().over(Window.partitionBy("match_id").orderBy("minute", "idx"))
    return match_events(spark, d).select("match_id", "idx", windows.running_max("minute", ["match_id"], ["idx"]).alias("effective_minute"), (F.col("idx") != other).alias("moved"))


@query("SELECT user_id, min_by(event_id, (ts, event_id)) AS first_event, max_by(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1")
def WN7_first_last(spark, d):
    """First and last row of each key (WN7, WN8) by aggregation, without sorting rows."""
    key = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", key).alias("first_event"), F.max_by("event_id", key).alias("last_event"))


@query("SELECT o_custkey, o_orderkey, slot FROM (SELECT o_custkey, o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey) AS latest, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS slot FROM orders WHERE true QUALIFY o_orderdate >= latest - INTERVAL 400 DAY) WHERE slot <= 3")
def WN10_recent_slots(spark, d):
    """Rows within 400 days of their key's latest (WN9), of these the first three with their slot (WN10)."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("latest", F.max("o_orderdate").over(Window.partitionBy("o_custkey")))
    return windows.top(o.where(F.col("o_orderdate") >= F.expr("latest - INTERVAL 400 DAY")), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3, "slot").select("o_custkey", "o_orderkey", "slot")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 + 2000000000 AS surrogate, o_orderstatus FROM orders")
def WN14_surrogates(spark, d):
    w = Window.partitionBy("o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(w) - 1 + F.lit(2_000_000_000).cast("long")).alias("surrogate"), "o_orderstatus")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_returnflag LIMIT 3")
def SO4_largest(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_returnflag").limit(3)


@query(FX + "SELECT league, home_team_id AS team_id FROM f UNION SELECT league, away_team_id FROM f")
def STU2_teams(spark, d):
    f = fixtures(spark, d)
    return f.select("league", F.col("home_team_id").alias("team_id")).union(f.select("league", "away_team_id")).distinct()


@query("SELECT k, side FROM ((SELECT DISTINCT c_nationkey AS k, 'both' AS side FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)) UNION ALL (SELECT DISTINCT c_nationkey, 'left' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) UNION ALL (SELECT DISTINCT s_nationkey, 'right' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer)))")
def STU5_differences(spark, d):
    """Intersection and both differences (ST-U4, ST-U5, ER7)."""
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda x, s: x.withColumn("side", F.lit(s))
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "left")).union(tag(b.subtract(a), "right"))


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-12-31') AS gap, round(date_diff('day', o_orderdate::DATE, DATE '1998-12-31') / 365.25, 1) AS years, cast(date_trunc('month', o_orderdate) AS date) AS month, cast(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS date) AS next_month, year(o_orderdate) || '/' || (year(o_orderdate) + 1) AS season, round(log10(o_totalprice), 6) AS lg, sha256(o_orderkey::VARCHAR) AS digest FROM orders")
def FN8_dates(spark, d):
    """Day gaps, years, months (FN8), seasons (FN9), logarithms (FN11), digests (FN16)."""
    day, end = F.col("o_orderdate").cast("date"), F.to_date(F.lit("1998-12-31"))
    y = F.year(day)
    return table(spark, d, "orders").select(
        "o_orderkey", F.datediff(end, day).alias("gap"), F.round(F.datediff(end, day) / 365.25, 1).alias("years"), F.trunc(day, "MM").alias("month"),
        F.add_months(F.trunc(day, "MM"), 1).alias("next_month"), F.concat_ws("/", y, y + 1).alias("season"), F.round(F.log10("o_totalprice"), 6).alias("lg"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"),
    )


@query(FX + "SELECT match_id, round(1 / odds_h / (1 / odds_h + 1 / odds_d + 1 / odds_a), 6) AS p_home, round(1 / odds_d / (1 / odds_h + 1 / odds_d + 1 / odds_a), 6) AS p_draw, round(1 / odds_a / (1 / odds_h + 1 / odds_d + 1 / odds_a), 6) AS p_away, round(1 / odds_h + 1 / odds_d + 1 / odds_a, 6) AS overround FROM f")
def FN12_de_vig(spark, d):
    names = ("p_home", "p_draw", "p_away", "overround")
    return fixtures(spark, d).select("match_id", *[F.round(c, 6).alias(n) for c, n in zip(de_vig("odds_h", "odds_d", "odds_a"), names)])


@query("SELECT DISTINCT p_name AS name, upper(replace(p_name, ' ', '-')) AS variant, lower(trim(replace(upper(replace(p_name, ' ', '-')), '-', ' '))) AS normal, levenshtein(p_name, substr(p_name, 1, length(p_name) - 1)) AS edits FROM part")
def FN1_normalise(spark, d):
    """Normal form of names (FN1, FN2) and edit distance (FN3)."""
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    v = F.upper(F.replace("name", F.lit(" "), F.lit("-")))
    return n.select("name", v.alias("variant"), normalise(v).alias("normal"), F.levenshtein("name", F.expr("substring(name, 1, length(name) - 1)")).alias("edits"))


def resolved_sql(pool: str, src: str, short: int = 0) -> str:
    """Names (source_name) of a query resolved in a pool (name) by all pairs: share of tokens, token distance, edits."""
    cost = "CASE WHEN starts_with(t, u) OR starts_with(u, t) THEN 0 WHEN levenshtein(t, u) <= 1 THEN 1 END"
    split = "list_filter(string_split({}, ' '), lambda t: t <> '')"
    return f"""WITH pool AS ({pool}), src AS ({src}),
 n AS (SELECT source_name, name, lower(trim(replace(source_name, '-', ' '))) AS a, lower(trim(replace(name, '-', ' '))) AS b FROM src, pool),
 c AS (SELECT *, a = b AS exact, len({split.format("a")}) AS tokens, list_filter(list_transform({split.format("a")}, lambda t: list_min(list_transform({split.format("b")}, lambda u: {cost}))), lambda x: x IS NOT NULL) AS costs FROM n),
 s AS (SELECT source_name, name, exact, CASE WHEN exact THEN 1 WHEN length(a) <= {short} OR tokens = 0 THEN 0 ELSE len(costs) / tokens END AS ratio, coalesce(list_sum(costs), 0) AS distance, levenshtein(a, b) AS edit FROM c),
 k AS (SELECT *, row_number() OVER w AS k, lead(ratio) OVER w = ratio AND lead(distance) OVER w = distance AND lead(edit) OVER w = edit AS tied FROM s WINDOW w AS (PARTITION BY source_name ORDER BY exact DESC, ratio DESC, distance, edit, name))
 SELECT source_name, CASE WHEN exact OR (ratio >= 0.5 AND NOT coalesce(tied, false)) THEN name END AS canonical,
  CASE WHEN exact THEN 'exact' WHEN ratio < 0.5 THEN 'below_threshold' WHEN tied THEN 'ambiguous' ELSE 'fuzzy' END AS method, round(ratio, 6) AS ratio FROM k WHERE k = 1"""


@query(resolved_sql("SELECT DISTINCT p_name AS name FROM part", """SELECT name AS source_name FROM pool UNION SELECT upper(replace(name, ' ', '-')) FROM pool UNION SELECT substr(name, 1, length(name) - 1) FROM pool
 UNION SELECT substr(name, 1, 2) || 'q' || substr(name, 3) FROM pool UNION SELECT string_split(name, ' ')[1] || ' zz' FROM pool UNION SELECT n_name FROM nation"""))
def ER2_resolve(spark, d):
    """Names to a pool: exact after normalising, else by shared tokens and edits; ties are ambiguous (FN4, ER2-ER4, JN18)."""
    pool = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    forms = [F.col("name"), F.upper(F.replace("name", F.lit(" "), F.lit("-"))), F.expr("substring(name, 1, length(name) - 1)"), F.expr("substring(name, 1, 2) || 'q' || substring(name, 3)"), F.expr("split(name, ' ')[0] || ' zz'")]
    src = pool.select(F.explode(F.array(*forms)).alias("source_name")).union(table(spark, d, "nation").select("n_name")).distinct()
    from matchloom.operators.resolve import resolve

    return resolve(src, pool, token_similarity)
