"""Expectations, lookups and set operations over the fixtures, each as a report of what was found."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.plans.registry import query
from matchloom.sources.views import FIXTURES_SQL, fixtures, table

FX = f"WITH f AS ({FIXTURES_SQL}) "


@query(FX + "SELECT match_id, n_name AS home FROM f LEFT JOIN nation ON home_team_id = n_nationkey AND n_regionkey < 3")
def JN2_left(spark, d):
    """A left join: rows without a partner keep a null."""
    names = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("home_team_id"), F.col("n_name").alias("home"))
    return fixtures(spark, d).select("match_id", "home_team_id").join(names, "home_team_id", "left").select("match_id", "home")


@query(FX + "SELECT match_id, home_team_id AS team_id, home_score AS gf FROM f UNION ALL SELECT match_id, away_team_id, away_score FROM f")
def STU1_union(spark, d):
    """UNION ALL by name: a row for each side of a match."""
    f = fixtures(spark, d)
    side = lambda s: f.select("match_id", F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_score").alias("gf"))
    return side("home").unionByName(side("away"))


@query(FX + "SELECT DISTINCT league, season, home_team_id FROM f")
def STU3_distinct(spark, d):
    return fixtures(spark, d).select("league", "season", "home_team_id").distinct()


@query(FX + "SELECT league, season, n_teams, n_teams = max(n_teams) OVER (PARTITION BY league) AS complete FROM (SELECT league, season, count(DISTINCT home_team_id) AS n_teams FROM f GROUP BY 1, 2)")
def AG9_distinct_counts(spark, d):
    """Teams of each season, and whether it has as many as the league's fullest."""
    n = fixtures(spark, d).groupBy("league", "season").agg(F.count_distinct("home_team_id").alias("n_teams"))
    return n.withColumn("complete", F.col("n_teams") == F.max("n_teams").over(Window.partitionBy("league")))


@query(FX + "SELECT count(*) AS n, count(*) - count(DISTINCT match_id) AS n_repeated, count(*) = count(DISTINCT match_id) AS holds FROM f")
def EX1_unique_key(spark, d):
    per = fixtures(spark, d).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("n_repeated"), (F.max("n") == 1).alias("holds"))


@query(FX + "SELECT season, count(odds_h + odds_d + odds_a) / count(*) AS share, count(odds_h + odds_d + odds_a) / count(*) >= 0.95 AS holds FROM f GROUP BY season")
def EX9_coverage_floor(spark, d):
    share = F.count(F.col("odds_h") + F.col("odds_d") + F.col("odds_a")) / F.count(F.lit(1))
    return fixtures(spark, d).groupBy("season").agg(share.alias("share"), (share >= 0.95).alias("holds"))


@query(FX + "SELECT match_id, count(*) AS n, count(*) = 2 AS holds FROM (SELECT match_id, home_team_id AS t FROM f UNION SELECT match_id, away_team_id FROM f) GROUP BY match_id")
def EX10_two_teams(spark, d):
    """Exactly two different teams in each match."""
    teams = fixtures(spark, d).select("match_id", F.explode(F.array_distinct(F.array("home_team_id", "away_team_id"))).alias("t"))
    return teams.groupBy("match_id").agg(F.count("t").alias("n")).withColumn("holds", F.col("n") == 2)
