"""Domain tables as views of the star schema: fixtures, their events, dated ratings, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.windows import prior

#: The same view for a checking engine.
FIXTURES_SQL = """SELECT o_orderkey AS match_id, cast(o_orderdate AS date) AS match_date, year(o_orderdate) AS season, nh.n_regionkey AS league,
  nh.n_nationkey AS home_team_id, na.n_nationkey AS away_team_id, hs AS home_score, aws AS away_score,
  (qa + qn + qr) / (1.05 * qa) AS odds_h, (qa + qn + qr) / (1.05 * qn) AS odds_d, (qa + qn + qr) / (1.05 * qr) AS odds_a
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS sk, count(*) FILTER (WHERE l_returnflag = 'A') AS hs, count(*) FILTER (WHERE l_returnflag = 'R') AS aws,
    sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS qa, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS qn, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS qr
    FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = sk
  JOIN nation nh ON nh.n_nationkey = c_nationkey JOIN nation na ON na.n_nationkey = s_nationkey
  WHERE nh.n_regionkey = na.n_regionkey AND nh.n_nationkey <> na.n_nationkey"""
EVENTS_SQL = """SELECT user_id AS match_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
  CASE WHEN event_id % 37 = 0 THEN 0 ELSE day(ts) - 1 END AS minute, event_type AS type, cast(json_extract_string(props, '$.k') AS int) % 2 AS team_id,
  cast(json_extract_string(props, '$.k') AS int) * 1.2 AS x, cast(floor((day(ts) - 1) / 2) AS int) AS possession, value / 500 AS shot_xg, value FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a stored table that a task sorts or groups at most, where the number of tasks follows from the table.
ROWS_A_TASK = 500_000


def parts(spark: SparkSession, sf_dir: str, name: str, times: int = 1) -> int:
    """Partitions for a step that makes `times` rows of each row of a table; the count comes from the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-times * table(spark, sf_dir, name).count() // ROWS_A_TASK))


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order between two nations of a region, as a match of its league with scores and odds."""
    flag = lambda f: F.col("l_returnflag") == f
    qty = lambda f: F.sum(F.when(flag(f), F.col("l_quantity")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("sk"), F.count_if(flag("A")).alias("home_score"), F.count_if(flag("R")).alias("away_score"),
        qty("A").alias("qa"), qty("N").alias("qn"), qty("R").alias("qr"),
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")  # a fixed table of countries
    home = nation.toDF("home_team_id", "league")
    away = nation.toDF("away_team_id", "away_league")
    total = F.col("qa") + F.col("qn") + F.col("qr")
    odds = lambda q: F.when(F.col(q) != 0, total / (1.05 * F.col(q)))
    return (
        table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("home_team_id")), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("away_team_id")), F.col("s_suppkey") == F.col("sk"))
        .join(home, "home_team_id").join(away, "away_team_id")
        .where("league = away_league AND home_team_id <> away_team_id")
        .select(
            F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").cast("date").alias("match_date"), F.year("o_orderdate").alias("season"), "league",
            "home_team_id", "away_team_id", "home_score", "away_score", odds("qa").alias("odds_h"), odds("qn").alias("odds_d"), odds("qr").alias("odds_a"),
        )
    )


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as matches of 30 minutes; every 37th event has a broken clock."""
    from pyspark.sql import Window

    k = F.get_json_object("props", "$.k").cast("int")
    day = F.day("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("match_id"), "event_id",
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("idx"),
        F.when(F.col("event_id") % 37 == 0, 0).otherwise(day - 1).alias("minute"), F.col("event_type").alias("type"),
        (k % 2).alias("team_id"), (k * 1.2).cast("double").alias("x"), F.floor((day - 1) / 2).cast("int").alias("possession"), (F.col("value") / 500).alias("shot_xg"), "value",
    )


def dated_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(player, effective_date, overall): the largest quantity of a part on a ship date."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("player"), F.col("l_shipdate").cast("date").alias("effective_date"), "l_quantity")
    return rows.repartition(parts(spark, sf_dir, "lineitem"), "player").groupBy("player", "effective_date").agg(F.max("l_quantity").alias("overall"))


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, player, match_date): a part of an order, once, with the order's date."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("match_date"))
    slots = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("player")).repartition(parts(spark, sf_dir, "lineitem"), "l_orderkey")
    return slots.join(orders, "l_orderkey").distinct()


PREDICTIONS_SQL = f"""SELECT match_id, match_date, season, league, y, (1 + coalesce(sum(h) OVER w, 0)) / (3 + count(*) OVER w) AS p_h, (1 + coalesce(sum(d) OVER w, 0)) / (3 + count(*) OVER w) AS p_d,
  (1 + coalesce(sum(a) OVER w, 0)) / (3 + count(*) OVER w) AS p_a, odds_h, odds_d, odds_a FROM (SELECT *, (y = 'H')::INT AS h, (y = 'D')::INT AS d, (y = 'A')::INT AS a FROM
  (SELECT *, CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS y FROM ({FIXTURES_SQL}) f))
  WINDOW w AS (PARTITION BY home_team_id ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast for each fixture: the home team's earlier outcomes, with one of each added."""
    from matchloom.functions.scores import result

    f = fixtures(spark, sf_dir).withColumn("y", result("home_score", "away_score"))
    w = prior(["home_team_id"], ["match_date", "match_id"])
    share = lambda k: (1 + F.coalesce(F.sum((F.col("y") == k).cast("int")).over(w), F.lit(0))) / (3 + F.count(F.lit(1)).over(w))
    return f.select("match_id", "match_date", "season", "league", "y", share("H").alias("p_h"), share("D").alias("p_d"), share("A").alias("p_a"), "odds_h", "odds_d", "odds_a")
