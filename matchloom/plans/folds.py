"""Ordered folds: ratings as a table function, over pools and as a stream, and what rests on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions.scores import result
from matchloom.operators.ratings import rate, rate_pools, rate_stream
from matchloom.plans.registry import query
from matchloom.sources.files import kept, shared_folder
from matchloom.sources.views import EVENTS_SQL, FIXTURES_SQL, fixtures, match_events
from matchloom.streaming import live, scans

_PUT = "list_transform({0}, lambda x, i: CASE WHEN i = h THEN {1} WHEN i = a THEN {2} ELSE x END)"
#: The fold in SQL: a step for each match of a league, its state as lists by team.
RATED = f"""WITH RECURSIVE f AS ({FIXTURES_SQL}),
o AS (SELECT *, home_team_id + 1 AS h, away_team_id + 1 AS a, row_number() OVER (PARTITION BY league ORDER BY match_date, match_id) AS k FROM f),
z AS (SELECT list_transform(range(max(n_nationkey) + 1), lambda x: 0.0::DOUBLE) AS zero FROM nation),
s AS (
  SELECT league, 0::BIGINT AS k, NULL::BIGINT AS season, NULL::BIGINT AS first, list_transform(zero, lambda x: NULL::DOUBLE) AS e, zero AS ph, zero AS pa,
    NULL::BIGINT AS match_id, NULL::DOUBLE AS eh, NULL::DOUBLE AS ea, NULL::DOUBLE AS p, NULL::DOUBLE AS hh, NULL::DOUBLE AS ha, NULL::DOUBLE AS ah, NULL::DOUBLE AS aa, NULL::DOUBLE AS g
  FROM (SELECT DISTINCT league FROM f), z
  UNION ALL
  SELECT league, k, season, first, {_PUT.format("e", "eh + 20 * (won - p)", "ea - 20 * (won - p)")}, {_PUT.format("ph", "hh + shift", "ah - 0.7 * shift")}, {_PUT.format("pa", "ha + 0.7 * shift", "aa - shift")},
    match_id, eh, ea, p, hh, ha, ah, aa, g
  FROM (SELECT *, 0.035 * sign(d - g) * 3 * log10(1 + abs(d - g)) AS shift FROM (
    SELECT *, 1 / (1 + power(10, -(eh + 70 - ea) / 400)) AS p, (CASE WHEN hh < 0 THEN -1 ELSE 1 END) * (power(10, abs(hh) / 3) - 1) - (CASE WHEN aa < 0 THEN -1 ELSE 1 END) * (power(10, abs(aa) / 3) - 1) AS g,
      (sign(d) + 1) / 2 AS won FROM (
    SELECT *, coalesce(e[a], CASE WHEN season = first THEN 1500 ELSE list_avg(list_append(e, CASE WHEN e[h] IS NULL THEN eh END)) - 50 END) AS ea FROM (
    SELECT *, coalesce(e[h], CASE WHEN season = first OR list_avg(e) IS NULL THEN 1500 ELSE list_avg(e) - 50 END) AS eh FROM (
    SELECT s.league, o.k, o.season, coalesce(s.first, o.season) AS first, o.match_id, o.h, o.a, (o.home_score - o.away_score)::DOUBLE AS d,
      CASE WHEN s.season <> o.season THEN list_transform(s.e, lambda x: 0.75 * x + 0.25 * list_avg(s.e)) ELSE s.e END AS e, s.ph, s.pa, s.ph[o.h] AS hh, s.pa[o.h] AS ha, s.ph[o.a] AS ah, s.pa[o.a] AS aa
    FROM s JOIN o ON o.league = s.league AND o.k = s.k + 1)))))
)"""
_RATINGS = ", ".join(f"round({v}, 4) AS {c}" for c, v in (("elo_home_pre", "eh"), ("elo_away_pre", "ea"), ("elo_diff", "eh - ea"), ("elo_expected_home", "p"), ("pi_home_home_pre", "hh"), ("pi_home_away_pre", "ha"), ("pi_away_home_pre", "ah"), ("pi_away_away_pre", "aa"), ("pi_expected_gd", "g")))
_SQL = f"{RATED} SELECT match_id, {_RATINGS} FROM s WHERE match_id IS NOT NULL"


@query(_SQL)
def RT1_ratings(spark, d):
    """Elo and pi before each match (RT1, RT2, UD5), by a table function over each league's matches in order."""
    return rate(fixtures(spark, d))


@query(_SQL)
def RT1_pools(spark, d):
    """The same, with each pool of a league folded by itself."""
    return rate_pools(kept(fixtures(spark, d)))


def season_by_season(f):
    """rate() of kept matches by a stream: a season's files are one batch, as they stand in no order among themselves."""
    spark = f.sparkSession
    path, out = shared_folder(spark), shared_folder(spark)
    for (season,) in sorted(f.select("season").distinct().collect()) or [(None,)]:
        f.where(F.col("season") == season).write.mode("append").parquet(path)
        rated = live.drained(rate_stream(spark.readStream.schema(f.schema).parquet(path)), "append", out)
    return rated


@query(_SQL)
def UD5_stream_ratings(spark, d):
    """The same from a stream that brings a season at a time; the state of a league is a map of its teams."""
    return season_by_season(kept(fixtures(spark, d)))


@query(f"{RATED} SELECT count(*) AS n, round(avg((hs > aws)::INT), 6) AS home_wins, round(avg((p > 0.5)::INT), 6) AS favoured FROM s JOIN (SELECT match_id, home_score AS hs, away_score AS aws FROM f) USING (match_id)")
def RT4_rating_sanity(spark, d):
    """How often the home team wins against how often its rating before the match favours it."""
    f = fixtures(spark, d)
    won = f.select("match_id", (result("home_score", "away_score") == "H").cast("int").alias("won"))
    j = rate(f).join(won, "match_id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("won"), 6).alias("home_wins"), F.round(F.avg((F.col("elo_expected_home") > 0.5).cast("int")), 6).alias("favoured"))


_SCAN = f"""WITH e AS ({EVENTS_SQL}), o AS (SELECT *, row_number() OVER (ORDER BY match_id, idx) - 1 AS pos FROM e)
 SELECT match_id, min(pos) AS first, count(*) AS events, count_if(type = 'purchase') AS purchases, round(sum(value), 4) AS total, true AS contiguous FROM o GROUP BY match_id"""


def event_file(spark, d):
    """The events as files in which each match's rows stand together, read with their places."""
    path = shared_folder(spark)
    match_events(spark, d).repartitionByRange("match_id").sortWithinPartitions("match_id", "idx").write.parquet(path)
    return scans.positions(spark.read.parquet(path))


@query(_SCAN)
def SC9_entity_scan(spark, d):
    """Each match of a file summed up as it ends, its rows carried over from slice to slice; none comes again."""
    path, rows = scans.in_slices(event_file(spark, d).select("pos", "match_id", "type", "value"), 4)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return live.drained(scans.scan_stream(stream), "append").withColumn("total", F.round("total", 4))


@query(_SCAN)
def SC9_entity_runs(spark, d):
    """The same by one aggregation over places."""
    return scans.runs(event_file(spark, d)).withColumn("total", F.round("total", 4))
