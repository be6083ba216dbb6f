"""Scans of nested JSON and season CSV files, and sinks that replace or carry rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MATCH = "match_id long, match_date date, competition struct<competition_id:int, season:int>, home_team struct<home_team_id:int>, away_team struct<away_team_id:int>, home_score long, away_score long"
EVENT = "match_id long, id long, type struct<name:string>, team struct<id:int>, location array<double>, foul struct<card:string>, bad_behaviour struct<card:string>"
LINEUP = "match_id long, teams array<struct<team:string, players:array<struct<player_id:long, cards:array<int>, positions:array<struct<at:string, period:int>>>>>>"


def shared_folder(spark: SparkSession) -> str:
    """A new path that the driver and all executors see: in spark.checkpoint.dir, which only a local master may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so a lost executor costs no more than what reads it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flatten_matches(raw: DataFrame) -> DataFrame:
    """One flat row for each match; a missing team or competition gives nulls."""
    return raw.select(
        "match_id", "match_date", F.col("competition.competition_id").alias("league"), F.col("competition.season").alias("season"),
        F.col("home_team.home_team_id").alias("home_team_id"), F.col("away_team.away_team_id").alias("away_team_id"), "home_score", "away_score",
    )


def flatten_events(raw: DataFrame) -> DataFrame:
    """Events with the first of a foul's and a misconduct's card, and x and y where there is a location."""
    at = lambda i: F.get("location", F.lit(i))
    return raw.select("match_id", F.col("id").alias("event_id"), F.col("type.name").alias("type"), F.col("team.id").alias("team_id"), at(0).alias("x"), at(1).alias("y"), F.coalesce("foul.card", "bad_behaviour.card").alias("card"))


def flatten_lineups(raw: DataFrame) -> DataFrame:
    """A row for each player of each team; started: the first position begins at 00:00 in period 1."""
    players = raw.select("match_id", F.explode("teams").alias("t")).select("match_id", "t.team", F.explode("t.players").alias("p"))
    first = F.get("p.positions", F.lit(0))
    return players.select("match_id", "team", "p.player_id", F.coalesce((first["at"] == "00:00") & (first["period"] == 1), F.lit(False)).alias("started"), F.size("p.cards").alias("n_cards"))


def season_of_path(path: Column) -> Column:
    """'…9596…' in a folder's name as '1995/1996'; years from 50 on are of the last century."""
    year = lambda i: F.regexp_extract(path, r"code=(\d\d)(\d\d)/", i)
    full = lambda y: F.concat(F.when(y >= "50", "19").otherwise("20"), y)
    return F.concat_ws("/", full(year(1)), full(year(2)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def carry_forward(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys it lacks, marked as carried."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return new.withColumn("carried", F.lit(False)).unionByName(kept.withColumn("carried", F.lit(True)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, digest) of the files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))
