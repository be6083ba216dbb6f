"""Synthetic rows for the rarer classes of each training season and league."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.scores import result
from matchloom.operators import balancing as b
from matchloom.plans.registry import query
from matchloom.sources.views import FIXTURES_SQL, fixtures

CELL = ["season", "league"]
K = 5
QUARTERS = [1, 2, 3, 4]
_ROWS = f"""WITH f AS ({FIXTURES_SQL}), t AS (SELECT match_id, season, league, CAST(quarter(match_date) AS INT) AS q, CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS y, odds_h, odds_a
  FROM f WHERE season <= 1998 AND odds_h IS NOT NULL AND odds_a IS NOT NULL),
 z AS (SELECT *, max(n) OVER (PARTITION BY season, league) - n AS need FROM (SELECT season, league, y, count(*) AS n FROM t GROUP BY 1, 2, 3)),
 r AS (SELECT t.*, n, need FROM t JOIN z USING (season, league, y))"""
_BY = "PARTITION BY season, league{} ORDER BY odds_h, match_id"
_D = "('0x' || substr(md5('{}' || ':' || match_id{}), 1, 8))::BIGINT"
_U = "{} / 4294967296.0"


def training(spark, d):
    f = fixtures(spark, d).withColumns({"y": result("home_score", "away_score"), "q": F.quarter("match_date")})
    rows = f.where("season <= 1998 AND odds_h IS NOT NULL AND odds_a IS NOT NULL").select("match_id", *CELL, "q", "y", "odds_h", "odds_a")
    return b.short_of(rows, CELL, "y")


def line(column):
    """The distance in the first price from a neighbour to the row."""
    return lambda e: F.abs(e[column] - F.col(column))


_NEAR = f"""nb AS (SELECT *, list({{'id': match_id, 'x': odds_h, 'y': y}}) OVER ({_BY.format('')} ROWS BETWEEN {K} PRECEDING AND {K} FOLLOWING) AS l FROM r),
 ns AS (SELECT * EXCLUDE (l), list_sort(list_transform(list_filter(l, lambda e: e.id <> match_id), lambda e: {{'d': abs(e.x - odds_h), 'id': e.id, 'x': e.x, 'y': e.y}}))[:{K}] AS near FROM nb),
 sh AS (SELECT *, CASE WHEN len(near) > 0 THEN len(list_filter(near, lambda e: e.y <> y)) / len(near) ELSE 0 END AS share FROM ns)"""


@query(f"""{_ROWS}, {_NEAR}, w AS (SELECT *, share >= 0.5 AND share < 1 AS border, sum(share) OVER (PARTITION BY season, league, y) AS total FROM sh),
 v AS (SELECT *, count(*) FILTER (WHERE border) OVER (PARTITION BY season, league, y) AS m, row_number() OVER (PARTITION BY season, league, y, border ORDER BY match_id) AS k FROM w)
 SELECT match_id, y, round(share, 6) AS share, border, CAST(CASE WHEN border THEN need // m + CASE WHEN k <= need % m THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS n_border,
  CAST(CASE WHEN total > 0 THEN floor(share / total * need + 0.5) ELSE 0 END AS BIGINT) AS n_adaptive FROM v""")
def PR9_danger(spark, d):
    """How many synthetic rows start at each row: even over the border (half or more of its five nearest neighbours are of
    other classes, not all), or in proportion to that share. The neighbours in the first price are exact, from one sort."""
    rows = training(spark, d)
    near = F.slice(b.neighbours(CELL, "odds_h", "match_id", ["odds_h", "y"], K, line("odds_h")), 1, K)
    rows = rows.withColumn("near", near)
    other = F.size(F.filter("near", lambda e: e["y"] != F.col("y")))
    rows = rows.withColumn("share", F.when(F.size("near") > 0, other / F.size("near")).otherwise(0.0)).withColumn("border", (F.col("share") >= 0.5) & (F.col("share") < 1))
    group = Window.partitionBy(*CELL, "y")
    rows = rows.withColumns({
        "total": F.sum("share").over(group), "m": F.count_if("border").over(group),
        "k": F.row_number().over(Window.partitionBy(*CELL, "y", "border").orderBy("match_id")),
    })
    even = F.when(F.col("border"), b.even_share(F.col("need"), F.col("k"), F.col("m"))).otherwise(0).cast("long")
    adaptive = F.when(F.col("total") > 0, F.floor(F.col("share") / F.col("total") * F.col("need") + 0.5)).otherwise(0).cast("long")
    return rows.select("match_id", "y", F.round("share", 6).alias("share"), "border", even.alias("n_border"), adaptive.alias("n_adaptive"))


_CLASS = f"""ci AS (SELECT *, row_number() OVER ({_BY.format(', y')}) AS k,
  list({{'id': match_id, 'x': odds_h, 'a': odds_a, 'q': q}}) OVER ({_BY.format(', y')} ROWS BETWEEN {K} PRECEDING AND {K} FOLLOWING) AS l FROM r),
 cp AS (SELECT *, unnest(range(need // n + CASE WHEN k <= need % n THEN 1 ELSE 0 END)) AS copy FROM ci WHERE need > 0)"""


@query(f"""{_ROWS}, {_CLASS}, cn AS (SELECT *, list_sort(list_transform(list_filter(l, lambda e: e.id <> match_id), lambda e: {{'d': abs(e.x - odds_h), 'id': e.id, 'q': e.q}}))[:{K}] AS near FROM cp),
 p AS (SELECT *, {_U.format(_D.format('u', " || ':' || copy"))} AS u, near[1 + {_D.format('n', " || ':' || copy")} % len(near)].q AS q2 FROM cn WHERE len(near) > 0)
 SELECT match_id, copy, y, q, q2, CASE WHEN u < 0.5 THEN q WHEN u > 0.5 THEN q2 ELSE least(q, q2) END AS snapped FROM p""")
def PR10_snap_back(spark, d):
    """The category of a row between two others: the one-hot parts are mixed as prices are, and the largest part is kept."""
    rows = training(spark, d).withColumns({
        "k": F.row_number().over(Window.partitionBy(*CELL, "y").orderBy("odds_h", "match_id")),
        "near": F.slice(b.neighbours([*CELL, "y"], "odds_h", "match_id", ["odds_h", "q"], K, line("odds_h")), 1, K),
    })
    s = b.repeated(rows.where(F.size("near") > 0), b.even_share(F.col("need"), F.col("k"), F.col("n")))
    s = s.withColumns({"u": b.uniform("u", "match_id", "copy"), "q2": F.get("near", (b.draw("n", "match_id", "copy") % F.size("near")).cast("int"))["q"]})
    return s.select("match_id", "copy", "y", "q", "q2", b.snapped(F.col("q"), F.col("q2"), F.col("u"), QUARTERS).alias("snapped"))


TRUNCATION, DEFORMATION = 1.0, 0.5
#: What a differing category adds to a squared distance: twice the square of half a deviation, here of the prices' scale.
NOMINAL = 2 * 0.5**2
_POINT = f"""g0 AS (SELECT *, list_sort(list_transform(list_filter(l, lambda e: e.id <> match_id), lambda e: {{'d': power(e.x - odds_h, 2) + power(e.a - odds_a, 2) + CASE WHEN e.q <> q THEN {NOMINAL} ELSE 0 END, 'id': e.id, 'x': e.x, 'a': e.a, 'q': e.q}}))[:{K}] AS near,
  list_sort(list_transform(list_filter(o, lambda e: e.y <> y), lambda e: {{'d': power(e.x - odds_h, 2) + power(e.a - odds_a, 2) + CASE WHEN e.q <> q THEN {NOMINAL} ELSE 0 END, 'id': e.id, 'x': e.x, 'a': e.a}}))[1] AS other FROM cp JOIN oo USING (match_id)),
 g1 AS (SELECT *, near[1 + {_D.format('n', " || ':' || copy")} % len(near)] AS own, {_U.format(_D.format('a', " || ':' || copy"))} AS angle, sqrt({_U.format(_D.format('r', " || ':' || copy"))}) AS radius FROM g0 WHERE len(near) > 0),
 g2 AS (SELECT *, CASE WHEN other.d < own.d THEN other.x ELSE own.x END - odds_h AS dx, CASE WHEN other.d < own.d THEN other.a ELSE own.a END - odds_a AS dy FROM g1),
 g3 AS (SELECT *, sqrt(dx * dx + dy * dy) AS size, radius * cos(2 * pi() * angle) AS vx, radius * sin(2 * pi() * angle) AS vy FROM g2),
 g4 AS (SELECT *, CASE WHEN size > 0 THEN dx / size ELSE 0 END AS ex, CASE WHEN size > 0 THEN dy / size ELSE 0 END AS ey FROM g3),
 g5 AS (SELECT * EXCLUDE (vx, vy), CASE WHEN abs({TRUNCATION} - (vx * ex + vy * ey)) > 1 THEN vx - 2 * (vx * ex + vy * ey) * ex ELSE vx END AS vx, CASE WHEN abs({TRUNCATION} - (vx * ex + vy * ey)) > 1 THEN vy - 2 * (vx * ex + vy * ey) * ey ELSE vy END AS vy FROM g4),
 g6 AS (SELECT * EXCLUDE (vx, vy), vx - {DEFORMATION} * (vx - (vx * ex + vy * ey) * ex) AS vx, vy - {DEFORMATION} * (vy - (vx * ex + vy * ey) * ey) AS vy FROM g5)"""
_OTHERS = f"oo AS (SELECT match_id, list({{'id': match_id, 'x': odds_h, 'a': odds_a, 'q': q, 'y': y}}) OVER ({_BY.format('')} ROWS BETWEEN {2 * K} PRECEDING AND {2 * K} FOLLOWING) AS o FROM r)"


@query(f"""{_ROWS}, {_CLASS}, {_OTHERS}, {_POINT}
 SELECT match_id, copy, y, round(odds_h + size * vx, 6) AS odds_h, round(odds_a + size * vy, 6) AS odds_a, round(size, 6) AS radius,
  (SELECT c FROM (SELECT unnest(list_transform(near, lambda e: e.q)) AS c) GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) AS q FROM g6""")
def PR11_geometric(spark, d):
    """Synthetic rows from a disc round each row of a rarer class, cut to the half that faces the point on its rim.

    That point is one of the five nearest rows of the class or the nearest row of another, whichever is nearer; a
    differing quarter adds to distances, and the quarter of the new row is the most frequent among the five. Neighbours
    are looked for within five places (ten for other classes) in the order of the first price, so that no pairs are made.
    """
    apart = lambda e: F.pow(e["odds_h"] - F.col("odds_h"), 2) + F.pow(e["odds_a"] - F.col("odds_a"), 2) + F.when(e["q"] != F.col("q"), NOMINAL).otherwise(0.0)
    fields = ["odds_h", "odds_a", "q"]
    rows = training(spark, d).withColumns({
        "k": F.row_number().over(Window.partitionBy(*CELL, "y").orderBy("odds_h", "match_id")),
        "near": F.slice(b.neighbours([*CELL, "y"], "odds_h", "match_id", fields, K, apart), 1, K),
        "other": F.get(b.neighbours(CELL, "odds_h", "match_id", [*fields, "y"], 2 * K, apart, lambda e: e["y"] != F.col("y")), F.lit(0)),
    })
    s = b.repeated(rows.where(F.size("near") > 0), b.even_share(F.col("need"), F.col("k"), F.col("n")))
    s = s.withColumn("own", F.get("near", (b.draw("n", "match_id", "copy") % F.size("near")).cast("int")))
    nearer = F.col("other.d") < F.col("own.d")
    rim = tuple(F.when(nearer, F.col(f"other.{c}")).otherwise(F.col(f"own.{c}")) for c in ("odds_h", "odds_a"))
    h, a, size = b.in_disc((F.col("odds_h"), F.col("odds_a")), rim, b.uniform("a", "match_id", "copy"), F.sqrt(b.uniform("r", "match_id", "copy")), TRUNCATION, DEFORMATION)
    quarter = b.mode(F.transform("near", lambda e: e["q"]))
    return s.select("match_id", "copy", "y", F.round(h, 6).alias("odds_h"), F.round(a, 6).alias("odds_a"), F.round(size, 6).alias("radius"), quarter.alias("q"))
