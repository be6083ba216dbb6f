"""Cross-checked stores, form from other sources' statistics, arm summaries, and rows for balancing classes."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.scores import clip, result
from matchloom.functions.text import token_similarity
from matchloom.operators.columns import resolve_groups
from matchloom.operators.resolve import resolve
from matchloom.operators.windows import home_away, prior_mean, running_max
from matchloom.plans.evaluation import ARMS, arms
from matchloom.plans.forecasting import COLS, _FORM, LONG, prematch
from matchloom.plans.registry import query
from matchloom.plans.relational import resolved_sql
from matchloom.sources.views import EVENTS_SQL, FIXTURES_SQL, fixtures, match_events, table

FX = f"WITH f AS ({FIXTURES_SQL}) "
_Y = "CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END"


@query(FX + f""", l AS (SELECT l_orderkey AS match_id, sum((l_returnflag = 'A')::INT - (l_returnflag = 'R')::INT) AS net FROM lineitem GROUP BY 1)
 SELECT match_id, {_Y} AS result, home_score - away_score AS margin_raw, CAST(greatest(-5, least(5, net)) AS BIGINT) AS label_margin,
  CASE WHEN net > 0 THEN 'H' WHEN net < 0 THEN 'A' ELSE 'D' END AS label_result, net = home_score - away_score AS agrees FROM f LEFT JOIN l USING (match_id)""")
def FP1_label_store(spark, d):
    """Labels counted from goal rows beside the match store's scores; agrees is false where they differ, null without goal rows."""
    net = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    labels = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.sum(net).alias("net"))
    margin = F.col("home_score") - F.col("away_score")
    return fixtures(spark, d).join(labels, "match_id", "left").select(
        "match_id", result("home_score", "away_score").alias("result"), margin.alias("margin_raw"), clip(F.col("net"), -5, 5).cast("long").alias("label_margin"),
        F.when(F.col("net") > 0, "H").when(F.col("net") < 0, "A").otherwise("D").alias("label_result"), (F.col("net") == margin).alias("agrees"),
    )


@query(f"""WITH e AS ({EVENTS_SQL}), v AS (SELECT *, max(minute) OVER (PARTITION BY match_id ORDER BY idx) AS eff,
  CASE WHEN shot_xg IS NULL THEN 'no value' WHEN type = 'signup' THEN 'not of play' WHEN x > 110 THEN 'off the pitch' END AS reason FROM e)
 SELECT 'kept' AS scope, type AS item, count(*) AS n FROM v WHERE reason IS NULL GROUP BY 2
 UNION ALL SELECT 'dropped', reason, count(*) FROM v WHERE reason IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'repaired', 'minute', count(*) FILTER (WHERE eff <> minute) FROM v WHERE reason IS NULL
 UNION ALL SELECT 'identity', 'types with one spelling', count(*) FILTER (WHERE k = 1) FROM (SELECT lower(type) AS t, count(DISTINCT type) AS k FROM v GROUP BY 1)""")
def FP2_clean_store(spark, d):
    """What a cleaned event store holds: kept rows by type, drops by first reason, repaired clocks, identities."""
    why = F.when(F.col("shot_xg").isNull(), "no value").when(F.col("type") == "signup", "not of play").when(F.col("x") > 110, "off the pitch")
    v = match_events(spark, d).withColumns({"eff": running_max("minute", ["match_id"], ["idx"]), "reason": why})
    kept = F.col("reason").isNull()
    # one pass: types, reasons and repairs are few
    cells = v.groupBy("type", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("eff") != F.col("minute")).alias("moved"))
    scope, item = F.when(kept, "kept").otherwise("dropped"), F.coalesce("reason", "type")
    rows = cells.groupBy(scope.alias("scope"), item.alias("item")).agg(F.sum("n").alias("n"))
    repaired = cells.where(kept).agg(F.coalesce(F.sum("moved"), F.lit(0)).alias("n")).select(F.lit("repaired").alias("scope"), F.lit("minute").alias("item"), "n")
    spelt = cells.groupBy(F.lower("type").alias("t")).agg(F.countDistinct("type").alias("k")).agg(F.count_if(F.col("k") == 1).alias("n"))
    return rows.unionByName(repaired).unionByName(spelt.select(F.lit("identity").alias("scope"), F.lit("types with one spelling").alias("item"), "n"))


STATS = ("shots", "volume", "fouls")
_STAT = {"shots": ("count(*)", ""), "volume": ("sum(l_quantity)", ""), "fouls": ("count(*)", " AND l_tax > 0.04")}
_SIDES = ", ".join(f"{v} FILTER (WHERE l_returnflag = '{k}'{also}) AS {c}_{k.lower()}" for c, (v, also) in _STAT.items() for k in "AR")
_FORMED = [f"form_{c}_{s}" for c in STATS for s in ("for", "against")]
_ROLLED = ", ".join(f"avg({c}_{s}) OVER w AS form_{c}_{s}" for c in STATS for s in ("for", "against"))
_OUT = ", ".join(f"round(h.{c}, 6) AS home_{c}, round(a.{c}, 6) AS away_{c}, round(h.{c} - a.{c}, 6) AS diff_{c}" for c in _FORMED)
_OWN = ", ".join(f"{c}_{{0}} AS {c}_for, {c}_{{1}} AS {c}_against" for c in STATS)


@query(f"""WITH f AS ({FIXTURES_SQL}), s AS (SELECT l_orderkey, {_SIDES} FROM lineitem GROUP BY 1),
 l AS (SELECT match_id, match_date, 'home' AS venue, home_team_id AS id, {_OWN.format("a", "r")} FROM f JOIN s ON l_orderkey = match_id
  UNION ALL SELECT match_id, match_date, 'away', away_team_id, {_OWN.format("r", "a")} FROM f JOIN s ON l_orderkey = match_id),
 r AS (SELECT match_id, venue, {_ROLLED} FROM l WHERE id % 7 <> 3 WINDOW w AS (PARTITION BY id ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
 SELECT match_id, {_OUT}, h.form_shots_for IS NOT NULL AND a.form_shots_for IS NOT NULL AS available
 FROM (SELECT * FROM r WHERE venue = 'home') h FULL JOIN (SELECT * FROM r WHERE venue = 'away') a USING (match_id)""")
def FP9_stat_form(spark, d):
    """Means of the last five matches' statistics, for and against, whose teams are found by two lookups.

    The source's name leads to an older alias and that to the team; names without an alias are left out, and the match
    is then marked as not available, as it is before a team's second match.
    """
    flag = lambda k: F.col("l_returnflag") == k
    sides = [c.alias(f"{n}_{k.lower()}") for k in "AR" for n, c in (("shots", F.count_if(flag(k))), ("volume", F.sum(F.when(flag(k), F.col("l_quantity")))), ("fouls", F.count_if(flag(k) & (F.col("l_tax") > 0.04))))]
    stats = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(*sides)
    nation = table(spark, d, "nation")
    source = F.concat(F.lit("FC "), F.upper("n_name"))
    name = lambda side: nation.select(F.col("n_nationkey").alias(f"{side}_team_id"), source.alias(f"{side}_name"))
    seen = fixtures(spark, d).join(name("home"), "home_team_id").join(name("away"), "away_team_id").join(stats, "match_id")
    side = lambda v, own, other: F.struct(F.lit(v).alias("venue"), F.col(f"{v}_name").alias("source_name"), *[F.col(f"{c}_{own}").alias(f"{c}_for") for c in STATS], *[F.col(f"{c}_{other}").alias(f"{c}_against") for c in STATS])
    rows = seen.select("match_id", "match_date", F.inline(F.array(side("home", "a", "r"), side("away", "r", "a"))))
    aliases = nation.where("n_nationkey % 7 <> 3").select(source.alias("source_name"), F.lower("n_name").alias("alias"))
    teams = nation.select(F.lower("n_name").alias("alias"), F.col("n_nationkey").alias("team"))
    rows = rows.join(aliases, "source_name").join(teams, "alias")
    formed = prior_mean(rows, ["team"], ["match_date", "match_id"], {c: c.removeprefix("form_") for c in _FORMED}, 5)
    wide = home_away(formed, "match_id", _FORMED)
    both = F.col("home_form_shots_for").isNotNull() & F.col("away_form_shots_for").isNotNull()
    return wide.select("match_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in wide.columns if c != "match_id"], both.alias("available"))


_GROUPS = [("meetings", "h2h"), ("venue", "venue"), ("form", "form"), ("schedule", "rest|played")]


@query(f"""WITH f AS ({FIXTURES_SQL}), {LONG}, {_FORM}, w AS (SELECT h.match_id, {", ".join(f"h.{c} - a.{c} AS {c}" for c in COLS)} FROM q h JOIN q a ON h.match_id = a.match_id AND h.venue = 'home' AND a.venue = 'away')
 SELECT 'meetings' AS "group", 1 AS columns, count(h2h_points) AS complete, round(avg(abs(h2h_points)), 6) AS spread FROM w
 UNION ALL SELECT 'venue', 1, count(venue_points), round(avg(abs(venue_points)), 6) FROM w
 UNION ALL SELECT 'form', 3, count(form_points + form_gf + form_ga), round(avg(abs(form_points) + abs(form_gf) + abs(form_ga)), 6) FROM w
 UNION ALL SELECT 'schedule', 2, count(rest_days + played_prior), round(avg(abs(rest_days) + abs(played_prior)), 6) FROM w""")
def PF9_column_groups(spark, d):
    """Difference columns claimed by ordered rules; each group's columns, complete rows and mean absolute size, in one pass."""
    out = prematch(fixtures(spark, d))
    groups = resolve_groups([c for c in out.columns if c.startswith("diff_")], _GROUPS)
    size = {g: reduce(add, [F.abs(c) for c in cs]) for g, cs in groups.items()}  # null if any is
    one = out.agg(*[F.struct(F.lit(g).alias("group"), F.lit(len(groups[g])).alias("columns"), F.count(v).alias("complete"), F.round(F.avg(v), 6).alias("spread")).alias(g) for g, v in size.items()])
    return one.select(F.inline(F.array(*groups)))


_SHORT = 8


@query(resolved_sql("SELECT n_name AS name FROM nation", "SELECT DISTINCT unnest([n_name, upper(n_name), n_name || 's']) AS source_name FROM nation", _SHORT))
def ER5_short_names(spark, d):
    """Names of at most eight letters match exactly or not at all; longer ones may match by similarity."""
    pool = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    forms = F.array(F.col("name"), F.upper("name"), F.concat("name", F.lit("s")))
    return resolve(pool.select(F.explode(forms).alias("source_name")).distinct(), pool, token_similarity, short=_SHORT)


@query(ARMS + """, s AS (SELECT model, season, avg(rps) AS v FROM scored GROUP BY 1, 2), b AS (SELECT *, v - max(CASE WHEN model = 'market' THEN v END) OVER (PARTITION BY season) AS gap, v = min(v) OVER (PARTITION BY season) AS first FROM s)
 SELECT model, count(*) AS seasons, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS deviation, round(avg(gap), 6) AS against_market, count(*) FILTER (WHERE first) AS best_in FROM b GROUP BY 1""")
def EV19_arm_summary(spark, d):
    """Each arm over the seasons: mean and deviation of its score, its gap to the market's, how often it is the best."""
    s = arms(spark, d).groupBy("model", "season").agg(F.avg("rps").alias("v"))
    w = Window.partitionBy("season")  # an arm each
    s = s.withColumns({"gap": F.col("v") - F.max(F.when(F.col("model") == "market", F.col("v"))).over(w), "first": F.col("v") == F.min("v").over(w)})
    return s.groupBy("model").agg(F.count(F.lit(1)).alias("seasons"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("deviation"), F.round(F.avg("gap"), 6).alias("against_market"), F.count_if("first").alias("best_in"))


@query(FX + """, t AS (SELECT league, season, unnest([home_team_id, away_team_id]) AS team FROM f), p AS (SELECT league, season, team, count(*) AS n FROM t GROUP BY 1, 2, 3),
 a AS (SELECT league, season, max(n) * 2 / sum(n) AS share, CAST(sum(n) / 2 AS BIGINT) AS matches FROM p GROUP BY 1, 2), o AS (SELECT league, season, count(odds_h) / count(*) AS priced FROM f GROUP BY 1, 2)
 SELECT league, season, matches, round(share, 6) AS top_team_share, round(priced, 6) AS priced,
  CASE WHEN share >= 0.5 THEN 'one team' WHEN priced < 0.1 THEN 'no prices' WHEN matches >= 60 THEN 'included' ELSE 'too few' END AS decision FROM a JOIN o USING (league, season)""")
def FP15_audit(spark, d):
    """A season's share of its busiest team, its prices, and whether it is taken, by ordered rules."""
    f = fixtures(spark, d)
    per = f.select("league", "season", F.explode(F.array("home_team_id", "away_team_id")).alias("team")).groupBy("league", "season", "team").agg(F.count(F.lit(1)).alias("n"))
    a = per.groupBy("league", "season").agg((F.max("n") * 2 / F.sum("n")).alias("share"), (F.sum("n") / 2).cast("long").alias("matches"))
    o = f.groupBy("league", "season").agg((F.count("odds_h") / F.count(F.lit(1))).alias("priced"))
    decision = F.when(F.col("share") >= 0.5, "one team").when(F.col("priced") < 0.1, "no prices").when(F.col("matches") >= 60, "included").otherwise("too few")
    return a.join(o, ["league", "season"]).select("league", "season", "matches", F.round("share", 6).alias("top_team_share"), F.round("priced", 6).alias("priced"), decision.alias("decision"))
