"""Files as they come in, and tables as they are replaced."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.plans.registry import query
from matchloom.sources import files, seasons, tables
from matchloom.sources.views import FIXTURES_SQL, fixtures

#: What a season's file is written in, by season modulo 3.
_ENCODINGS = ("latin-1", "utf-8", "utf-8-sig")
_NAME = "'Équipe ' || home_team_id || CASE WHEN match_id % 11 = 0 THEN ',x' ELSE '' END"
_SEASON = "season || '/' || (season + 1)"


def season_files(spark, d):
    """The fixtures as a CSV file or more a season in three encodings; some lines have a field too many, some no number for an id."""
    path, f = files.shared_folder(spark), files.kept(fixtures(spark, d))
    code = F.concat(F.lpad((F.col("season") % 100).cast("string"), 2, "0"), F.lpad(((F.col("season") + 1) % 100).cast("string"), 2, "0"))
    match = F.when(F.col("match_id") % 10 == 0, "n/a").otherwise(F.col("match_id").cast("string"))
    for i, encoding in enumerate(_ENCODINGS):
        mark = "\ufeff" if encoding == "utf-8-sig" else ""
        rows = f.where(F.col("season") % 3 == i).select(match.alias(f"{mark}Match"), F.expr(_NAME).alias("HomeTeam"), F.col("home_score").alias("FTHG"), code.alias("code"))
        if i == 1:
            rows = rows.select("HomeTeam", "Match", "FTHG", "code")  # columns come in another order
        out = rows.write.mode("append").partitionBy("code").option("header", True).option("quote", "\u0000").option("encoding", "ISO-8859-1" if i == 0 else "UTF-8")
        out.csv(path)
    return seasons.read(spark, path, {"Match": "long", "HomeTeam": "string", "FTHG": "int", "AwayTeam": "string"})


@query(f"""WITH f AS ({FIXTURES_SQL}) SELECT match_id, 'Équipe ' || home_team_id AS home_team, home_score, NULL AS away_team, {_SEASON} AS season,
  ['latin-1', 'utf-8', 'utf-8-sig'][season % 3 + 1] AS encoding FROM f WHERE match_id % 10 <> 0 AND match_id % 11 <> 0""")
def SC5_encodings(spark, d):
    """Season files in three encodings, each told by its bytes; columns by name, a missing one null."""
    rows, _ = season_files(spark, d)
    season = files.season_of_path(F.col("file"))
    return rows.select(F.col("Match").alias("match_id"), F.col("HomeTeam").alias("home_team"), F.col("FTHG").cast("long").alias("home_score"), F.col("AwayTeam").alias("away_team"), season.alias("season"), "encoding")


@query(f"""WITH f AS ({FIXTURES_SQL}) SELECT {_SEASON} AS season, CASE WHEN match_id % 11 = 0 THEN '4 fields, not 3' ELSE 'Match is no long' END AS reason, count(*) AS lines
  FROM f WHERE match_id % 10 = 0 OR match_id % 11 = 0 GROUP BY 1, 2""")
def SC5_rejects(spark, d):
    """The lines that were not taken, by season and reason."""
    _, rejects = season_files(spark, d)
    return rejects.groupBy(files.season_of_path(F.col("file")).alias("season"), "reason").agg(F.count(F.lit(1)).alias("lines"))


_OLD = "o AS (SELECT match_id, season, league, home_score AS goals FROM f WHERE season <= 1999), n AS (SELECT match_id, season, league, home_score + 10 AS goals, 'new' AS note FROM f WHERE season >= 1999 AND league < 3)"
_UPSERTED = f"WITH f AS ({FIXTURES_SQL}), {_OLD} SELECT *, NULL AS note FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.season = o.season AND n.league = o.league) UNION ALL SELECT * FROM n"


def versions(spark, d):
    f = fixtures(spark, d)
    old = f.where("season <= 1999").select("match_id", "season", "league", F.col("home_score").alias("goals"))
    return old, f.where("season >= 1999 AND league < 3").select("match_id", "season", "league", (F.col("home_score") + 10).alias("goals"), F.lit("new").alias("note"))


@query(_UPSERTED)
def SC13_sink(spark, d):
    """A stored table whose seasons and leagues are replaced by a later run, which is run twice and changes nothing the second time."""
    path = files.shared_folder(spark)
    old, new = versions(spark, d)
    for run, rows in (("first", old), ("second", new), ("second", new)):
        tables.replace(rows, path, ["season", "league"], run)
    return tables.current(spark, path).select("match_id", "season", "league", "goals", "note")


@query(_UPSERTED)
def SC13_stream_sink(spark, d):
    """The same from a stream: a batch is a run, so a batch that is run again changes nothing."""
    path = files.shared_folder(spark)
    batches_in(versions(spark, d), path)
    return tables.current(spark, path)


def batches_in(versions, path):
    """Each version's rows, in as many files as they need, as one batch of a stream that replaces seasons and leagues at path."""
    for rows in versions:
        spark, source = rows.sparkSession, f"{path}_source"
        rows.withColumn("note", F.col("note") if "note" in rows.columns else F.lit(None).cast("string")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("match_id long, season int, league int, goals long, note string").parquet(source)
        tables.replace_from_stream(stream, path, ["season", "league"], f"{path}_checkpoint")
