"""File scans, sinks and the stores that are built from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.scores import de_vig, result
from matchloom.operators.windows import top
from matchloom.plans.registry import query
from matchloom.sources import files, sqlite
from matchloom.sources.views import EVENTS_SQL, FIXTURES_SQL, fixtures, match_events, table

FX = f"WITH f AS ({FIXTURES_SQL}) "
FLAT = "match_id, match_date, league, season, home_team_id, away_team_id, home_score, away_score"


def raw_matches(f):
    return f.select(
        "match_id", "match_date", F.struct(F.col("league").alias("competition_id"), "season").alias("competition"), F.struct("home_team_id").alias("home_team"),
        F.struct("away_team_id").alias("away_team"), "home_score", "away_score",
    )


@query(FX + f"SELECT {FLAT}, CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS result, home_score - away_score AS margin FROM f")
def SC1_match_scan(spark, d):
    """Nested match JSON to flat rows with result and margin."""
    path = files.shared_folder(spark)
    raw_matches(fixtures(spark, d)).write.json(path)
    return files.flatten_matches(spark.read.schema(files.MATCH).json(path)).withColumns({"result": result("home_score", "away_score"), "margin": F.col("home_score") - F.col("away_score")})


@query(f"WITH e AS ({EVENTS_SQL}) SELECT match_id, event_id, type, team_id, CASE WHEN event_id % 5 > 0 THEN round(x::DOUBLE, 6) END AS x, CASE WHEN event_id % 5 > 1 THEN round(x::DOUBLE / 2, 6) END AS y, CASE WHEN type = 'error' AND team_id = 1 THEN 'Red Card' WHEN type = 'error' THEN 'Yellow Card' END AS card FROM e")
def SC2_event_scan(spark, d):
    """Nested event JSON to flat rows; locations of no, one and two numbers; cards from two places."""
    path, n = files.shared_folder(spark), F.col("event_id") % 5
    card = lambda team, said: F.when((F.col("type") == "error") & (F.col("team_id") == team), F.struct(F.lit(said).alias("card")))
    at = F.when(n > 1, F.array("x", F.col("x") / 2)).when(n == 1, F.array("x"))
    raw = match_events(spark, d).select(
        "match_id", F.col("event_id").alias("id"), F.struct(F.col("type").alias("name")).alias("type"), F.struct(F.col("team_id").alias("id")).alias("team"),
        at.alias("location"), card(0, "Yellow Card").alias("foul"), card(1, "Red Card").alias("bad_behaviour"),
    )
    raw.write.json(path)
    return files.flatten_events(spark.read.schema(files.EVENT).json(path)).withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("SELECT l_orderkey AS match_id, l_returnflag AS team, l_partkey AS player_id, l_linenumber < 3 AS started, cast(l_suppkey % 3 AS int) AS n_cards FROM lineitem")
def SC3_lineup_scan(spark, d):
    """Lineup JSON, two lists deep, to a row for each player."""
    path, line = files.shared_folder(spark), F.col("l_linenumber")
    positions = F.when(line < 5, F.array(F.struct(F.when(line < 3, "00:00").otherwise("60:00").alias("at"), F.when(line < 4, 1).otherwise(2).alias("period"))))
    cards = F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (F.col("l_suppkey") % 3).cast("int"))
    player = F.struct(F.col("l_partkey").alias("player_id"), cards.alias("cards"), positions.alias("positions"))
    teams = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(player).alias("players"))
    teams.groupBy(F.col("l_orderkey").alias("match_id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("team"), "players")).alias("teams")).write.json(path)
    return files.flatten_lineups(spark.read.schema(files.LINEUP).json(path))


@query(FX + ", s AS (SELECT DISTINCT season FROM f), c AS (SELECT r_regionkey AS league, r_name AS name, season FROM region, s) SELECT c.league, name, c.season, count(f.match_id) AS matches, count(DISTINCT f.home_team_id) AS teams FROM c LEFT JOIN f ON f.league = c.league AND f.season = c.season GROUP BY 1, 2, 3")
def SC4_catalogue(spark, d):
    """Each competition and season with its matches, 0 where there are none (SC4, FP15)."""
    f = fixtures(spark, d)
    per = f.groupBy("league", "season").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("home_team_id").alias("teams"))
    seasons = f.agg(F.sort_array(F.collect_set("season")).alias("s"))  # a value for each year
    listed = table(spark, d, "region").select(F.col("r_regionkey").alias("league"), F.col("r_name").alias("name")).join(F.broadcast(seasons)).select("league", "name", F.explode("s").alias("season"))
    return listed.join(per, ["league", "season"], "left").na.fill(0, ["matches", "teams"])


@query(FX + "SELECT match_id, home_score, away_score, season || '/' || (season + 1) AS season FROM f WHERE match_id % 10 <> 0")
def SC6_season_files(spark, d):
    """Season CSVs: the season from the folder's name (SC6), lines that don't parse left out (SC5)."""
    path, f = files.shared_folder(spark), fixtures(spark, d)
    code = F.concat(F.lpad((F.col("season") % 100).cast("string"), 2, "0"), F.lpad(((F.col("season") + 1) % 100).cast("string"), 2, "0"))
    rows = f.select(F.when(F.col("match_id") % 10 == 0, "broken").otherwise(F.col("match_id").cast("string")).alias("match_id"), "home_score", "away_score", code.alias("code"))
    rows.write.partitionBy("code").option("header", True).csv(path)
    read = spark.read.schema("match_id long, home_score long, away_score long").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return read.select("match_id", "home_score", "away_score", files.season_of_path(F.col("_metadata.file_path")).alias("season"))


_SC7 = "SELECT f.home_team_id, count(*) AS matches, CAST(sum(f.home_score) AS BIGINT) AS goals FROM {f} f JOIN {n} n ON f.home_team_id = n.n_nationkey WHERE f.season >= 1994 AND n.n_nationkey < 12 GROUP BY f.home_team_id"


@query(FX + _SC7.format(f="f", n="nation"))
def SC7_sql_scan(spark, d):
    """SQLite files read by SQL: the columns it names, its predicate in the files' own SQL, its join in Spark."""
    path = files.shared_folder(spark)
    sqlite.write(fixtures(spark, d), f"{path}/store", "Match")
    sqlite.write(table(spark, d, "nation"), f"{path}/names", "Team")
    f = sqlite.read(spark, f"{path}/store", "Match", ["home_team_id", "home_score", "season"])
    return spark.sql(_SC7, f=f, n=sqlite.read(spark, f"{path}/names", "Team", ["n_nationkey"]))


@query(FX + "SELECT match_id, league, home_score FROM f WHERE league IN (1, 3)")
def SC8_filtered_ingest(spark, d):
    """A CSV cut to three columns and two leagues as it is read, kept as Parquet."""
    path, f = files.shared_folder(spark), fixtures(spark, d).select("match_id", "league", "home_team_id", "away_team_id", "home_score", "away_score")
    f.write.option("header", True).csv(path)
    spark.read.schema(f.schema).option("header", True).csv(path).select("match_id", "league", "home_score").where(F.col("league").isin(1, 3)).write.parquet(path + "_kept")
    return spark.read.parquet(path + "_kept")


@query(FX + "SELECT season, count(*) >= 150 AS enough, count(odds_h) = count(*) AS priced FROM f GROUP BY season")
def SC10_ingest_contract(spark, d):
    """Whether each season's file holds 150 rows and every price."""
    n = F.count(F.lit(1))
    return fixtures(spark, d).groupBy("season").agg((n >= 150).alias("enough"), (F.count("odds_h") == n).alias("priced"))


@query()
def SC11_manifest(spark, d):
    """The size and digest of each file of a CSV sink (SC11, SC12)."""
    path = files.shared_folder(spark)
    fixtures(spark, d).select("match_id", "home_score", "away_score").write.mode("overwrite").option("header", True).csv(path)
    return files.manifest(spark, path).where("file LIKE 'part-%'")


_OLD = "o AS (SELECT match_id, season, league, home_score AS goals FROM f WHERE season <= 1999), n AS (SELECT match_id, season, league, home_score + 10 AS goals, 'new' AS note FROM f WHERE season >= 1999 AND league < 3)"


def versions(spark, d):
    f = fixtures(spark, d)
    return f.where("season <= 1999").select("match_id", "season", "league", F.col("home_score").alias("goals")), f.where("season >= 1999 AND league < 3").select("match_id", "season", "league", (F.col("home_score") + 10).alias("goals"), F.lit("new").alias("note"))


@query(FX + f", {_OLD} SELECT *, NULL AS note FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.season = o.season AND n.league = o.league) UNION ALL SELECT * FROM n")
def SC13_upsert(spark, d):
    """The rows of given seasons and leagues replaced; a column that the old rows lack is null there."""
    old, new = versions(spark, d)
    return files.upsert(old, new, ["season", "league"])


@query(FX + f", {_OLD} SELECT match_id, season, league, goals, true AS carried FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.match_id = o.match_id) UNION ALL SELECT match_id, season, league, goals, false FROM n")
def SC14_carry_forward(spark, d):
    """New rows, and those of the run before that it lacks, marked."""
    old, new = versions(spark, d)
    return files.carry_forward(old, new.drop("note"), ["match_id"])


@query(FX + "SELECT league, season, count(*) AS matches, count(o) AS priced, round(count(o) / count(*), 6) AS coverage, round(avg(1 / odds_h / o), 6) AS p_h, round(avg(o), 6) AS overround FROM (SELECT *, 1 / odds_h + 1 / odds_d + 1 / odds_a AS o FROM f) GROUP BY league, season")
def FP3_market_baseline(spark, d):
    """Prices without their margin, and how many matches have them."""
    h, _, _, o = de_vig("odds_h", "odds_d", "odds_a")
    n = F.count(F.lit(1))
    return fixtures(spark, d).withColumns({"h": h, "o": o}).groupBy("league", "season").agg(
        n.alias("matches"), F.count("o").alias("priced"), F.round(F.count("o") / n, 6).alias("coverage"), F.round(F.avg("h"), 6).alias("p_h"), F.round(F.avg("o"), 6).alias("overround")
    )


@query(FX + ", u AS (SELECT match_id, league, season, home_score, 1 AS rank FROM f WHERE league < 3 UNION ALL SELECT match_id, league, season, away_score, 2 FROM f WHERE league > 1) SELECT match_id, league, season, home_score AS goals, CASE rank WHEN 1 THEN 'first' ELSE 'second' END AS source FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY rank) AS k FROM u) WHERE k = 1")
def FP4_extended_store(spark, d):
    """Two overlapping sources; the first one's row stays where both have a match."""
    f = fixtures(spark, d)
    part = lambda where, goals, rank: f.where(where).select("match_id", "league", "season", F.col(goals).alias("goals"), F.lit(rank).alias("rank"))
    u = top(part("league < 3", "home_score", 1).unionByName(part("league > 1", "away_score", 2)), ["match_id"], [F.col("rank")])
    return u.select("match_id", "league", "season", "goals", F.when(F.col("rank") == 1, "first").otherwise("second").alias("source"))


@query(FX + ", m AS (SELECT league, season, median(odds_h) AS mid FROM f WHERE odds_h IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 20) SELECT match_id, round(coalesce(CASE WHEN match_id % 3 <> 0 THEN odds_h END, mid), 6) AS price, CASE WHEN match_id % 3 <> 0 AND odds_h IS NOT NULL THEN 'own' WHEN mid IS NOT NULL THEN 'median' ELSE 'none' END AS odds_source FROM f LEFT JOIN m USING (league, season)")
def FP5_price_fallback(spark, d):
    """A match's own price, else its season's median, else none; the source is named."""
    f = fixtures(spark, d)
    mid = f.where("odds_h IS NOT NULL").groupBy("league", "season").agg(F.median("odds_h").alias("mid"), F.count(F.lit(1)).alias("n")).where("n > 20").drop("n")
    own = F.when(F.col("match_id") % 3 != 0, F.col("odds_h"))
    return f.join(mid, ["league", "season"], "left").select("match_id", F.round(F.coalesce(own, "mid"), 6).alias("price"), F.when(own.isNotNull(), "own").when(F.col("mid").isNotNull(), "median").otherwise("none").alias("odds_source"))


@query(FX + "SELECT match_id, CASE WHEN league = 4 AND season = 1997 THEN 'excluded' WHEN season <= 1998 THEN 'train' WHEN season = 1999 THEN 'validation' ELSE 'test' END AS split FROM f")
def FP6_season_split(spark, d):
    """Splits by pinned seasons; a season beyond the last one fails (PF14); a held-out cell is excluded."""
    s = F.col("season")
    split = F.when(s <= 1998, "train").when(s == 1999, "validation").when(s <= 2001, "test").otherwise(F.raise_error(F.concat(F.lit("no split for season "), s.cast("string"))))
    return fixtures(spark, d).select("match_id", F.when((F.col("league") == 4) & (s == 1997), "excluded").otherwise(split).alias("split"))


@query("SELECT DISTINCT c_name AS name, 100000 + row_number() OVER (PARTITION BY b ORDER BY c_name) + (SELECT count(DISTINCT c_name) FROM customer x WHERE c_nationkey > 5 AND substr(md5(x.c_name), 1, 2) < b) AS team_id FROM (SELECT DISTINCT c_name, substr(md5(c_name), 1, 2) AS b FROM customer WHERE c_nationkey > 5)")
def ER6_new_ids(spark, d):
    """Gapless ids for unmatched names, numbered in 256 hashed buckets instead of one sorted list."""
    names = table(spark, d, "customer").where("c_nationkey > 5").select(F.col("c_name").alias("name")).distinct().withColumn("b", F.substring(F.md5("name"), 1, 2))
    sizes = names.groupBy("b").agg(F.count(F.lit(1)).alias("n"))  # 256 rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = F.row_number().over(Window.partitionBy("b").orderBy("name"))
    return names.join(F.broadcast(sizes.select("b", before.alias("before"))), "b").select("name", (100000 + k + F.col("before")).alias("team_id"))
