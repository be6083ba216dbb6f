"""Sequential ratings: Elo and pi, folded over matches in order, as a table function, from groups, over pools, or as a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from matchloom.operators.components import components
from matchloom.sources.files import kept

#: Fixed values of the rating rules.
ELO = {"start": 1500.0, "k": 20.0, "home": 70.0, "carry": 0.75, "newcomer": 50.0}
PI = {"c": 3.0, "rate": 0.035, "gamma": 0.7}
#: Values before a match.
NUMBERS = ["elo_home_pre", "elo_away_pre", "elo_diff", "elo_expected_home", "pi_home_home_pre", "pi_home_away_pre", "pi_away_home_pre", "pi_away_away_pre", "pi_expected_gd"]
_SCHEMA = "match_id long, " + ", ".join(f"{c} double" for c in NUMBERS)
#: What is known of a team: Elo, and pi at home and away.
Known = tuple[float, float, float]


def _signed(size: float, of: float) -> float:
    return np.copysign(size, of) if isinstance(of, np.ndarray) else math.copysign(size, of)


def _goals(r: float) -> float:
    return _signed(10.0 ** (abs(r) / PI["c"]) - 1.0, r)


def step(home: Known, away: Known, home_score: int, away_score: int, fixed: dict) -> tuple[tuple[float, ...], Known, Known]:
    """The values before a match in the order of NUMBERS, and what is known of both teams after it. Fixed values may be arrays, of a value a setting."""
    p = 1 / (1 + 10 ** (-(home[0] + fixed["home"] - away[0]) / 400))
    goals = _goals(home[1]) - _goals(away[2])
    before = (home[0], away[0], home[0] - away[0], p, home[1], home[2], away[1], away[2], goals)
    won = 1.0 if home_score > away_score else 0.0 if home_score < away_score else 0.5
    move = fixed["k"] * (won - p)
    error = home_score - away_score - goals
    log10 = np.log10 if isinstance(error, np.ndarray) else math.log10
    by = fixed.get("rate", PI["rate"]) * _signed(PI["c"] * log10(1 + abs(error)), error)
    return before, (home[0] + move, home[1] + by, home[2] + PI["gamma"] * by), (away[0] - move, away[1] - PI["gamma"] * by, away[2] - by)


class League:
    """A league's state: a season's start pulls all known teams to their mean; after the first season a newcomer starts
    below the mean of those known, the home team first. It holds three numbers a team."""

    def __init__(self, fixed: dict, season: int | None = None, first: int | None = None, teams: dict[int, Known] | None = None):
        self.fixed, self.season, self.first, self.teams = fixed, season, first, teams or {}

    def mean(self) -> float:
        return sum(t[0] for t in self.teams.values()) / len(self.teams)

    def play(self, season: int, home: int, away: int, home_score: int, away_score: int) -> tuple[float, ...]:
        self.first = season if self.first is None else self.first
        if self.season is not None and season != self.season:
            mean, carry = self.mean(), self.fixed["carry"]
            self.teams = {t: (carry * e + (1 - carry) * mean, *pi) for t, (e, *pi) in self.teams.items()}
        self.season = season
        for t in (home, away):
            if t not in self.teams:
                start = self.fixed["start"] if season == self.first or not self.teams else self.mean() - self.fixed["newcomer"]
                self.teams[t] = (start, 0.0, 0.0)
        before, self.teams[home], self.teams[away] = step(self.teams[home], self.teams[away], home_score, away_score, self.fixed)
        return before


_COLUMNS = ["match_id", "match_date", "season", "league", "home_team_id", "away_team_id", "home_score", "away_score"]


def _rounded(out: DataFrame, *keys: str, numbers: Sequence[str] = NUMBERS) -> DataFrame:
    return out.select(*keys, "match_id", *[F.round(c, 4).alias(c) for c in numbers])


def rate(matches: DataFrame, elo: dict | None = None) -> DataFrame:
    """match_id and NUMBERS: values before each match, folded by a table function over each league's matches in order.

    Spark sorts and hands the matches over one at a time, so a task holds the league's teams, not its matches. Matches need
    match_id, match_date, season, league, both team ids and scores. `elo` replaces some of the fixed values; `rate` is pi's.
    """
    fixed = ELO | (elo or {})

    class Rated:
        def __init__(self):
            self.league = League(fixed)

        def eval(self, m: Row) -> Iterator[tuple]:
            yield m.match_id, *self.league.play(m.season, m.home_team_id, m.away_team_id, m.home_score, m.away_score)

    fold = F.udtf(Rated, returnType=_SCHEMA)
    return _rounded(fold(matches.select(*_COLUMNS).asTable().partitionBy("league").orderBy("match_date", "match_id")))


def rate_all(matches: DataFrame, grid: list[dict], numbers: Sequence[str] = NUMBERS, also: Sequence[str] = ()) -> DataFrame:
    """rate() under each of a list of settings, as (candidate, also, match_id, numbers) from one job; candidate is the place in the list.

    What is sorted and shuffled are the matches, whatever the settings: a league's matches come to one task in order, in batches, and
    are folded under all settings at once, as arrays. `numbers` are those wanted, `also` columns of the matches to keep.
    """
    fixed = {key: np.array([(ELO | s)[key] for s in grid]) for key in ELO}
    if any("rate" in s for s in grid):
        fixed["rate"] = np.array([s.get("rate", PI["rate"]) for s in grid])
    wanted = [(c, NUMBERS.index(c)) for c in numbers]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, league = None, None
        for batch in batches:
            for key, m in batch.groupby("league", sort=False, dropna=False):  # a batch's rows stand league by league
                key = None if pd.isna(key) else key
                if league is None or key != name:
                    name, league = key, League(fixed)
                out = np.empty((len(wanted), len(m), len(grid)))
                for i, r in enumerate(m.itertuples()):
                    before = league.play(r.season, r.home_team_id, r.away_team_id, r.home_score, r.away_score)
                    for j, (_, at) in enumerate(wanted):
                        out[j, i] = before[at]
                rows = m.loc[m.index.repeat(len(grid)), [*also, "match_id"]]
                yield rows.assign(candidate=np.tile(np.arange(len(grid)), len(m)), **{c: out[j].ravel() for j, (c, _) in enumerate(wanted)})

    rows = matches.select(*dict.fromkeys([*_COLUMNS, *also])).repartition("league").sortWithinPartitions("league", "match_date", "match_id")
    schema = ", ".join(["candidate int", *[f"{c} {matches.schema[c].dataType.simpleString()}" for c in also], "match_id long", *[f"{c} double" for c in numbers]])
    return _rounded(rows.mapInPandas(fold, schema), "candidate", *also, numbers=numbers)


def starts(matches: DataFrame, fixed: dict) -> tuple[DataFrame, DataFrame]:
    """(league, team, start) and (league, era, season, mean): a newcomer's first Elo, and the mean to which a season's start pulls.

    No fold is needed for them. A match moves as many points from one team as to the other, and a pull to the mean keeps
    the sum; so the mean of n known teams changes by newcomers alone, by -newcomer / n with the n-th. Both tables come from a
    team's first match and a season's first and last. Seasons of a league must not overlap in time.
    """
    at = F.struct("match_date", "match_id")
    seasons = matches.groupBy("league", "season").agg(F.min(at).alias("begins"), F.max(at).alias("ends"))
    w = Window.partitionBy("league").orderBy("begins")  # a row for each season
    seasons = kept(seasons.withColumns({"era": F.row_number().over(w) - 1, "late": F.lag("ends").over(w) > F.col("begins")}))
    if not seasons.where("late").isEmpty():
        raise ValueError("seasons of a league overlap")
    sides = F.array(F.struct(F.col("home_team_id").alias("team"), F.lit(0).alias("side")), F.struct(F.col("away_team_id").alias("team"), F.lit(1).alias("side")))
    seen = matches.select("league", "season", at.alias("at"), F.inline(sides)).groupBy("league", "team").agg(F.min(F.struct("at", "side", "season")).alias("f"))
    seen = seen.select("league", "team", F.col("f.at").alias("at"), F.col("f.side").alias("side"), F.col("f.season").alias("season")).join(seasons.select("league", "season", "era"), ["league", "season"])
    order = Window.partitionBy("league").orderBy("at", "side")  # a row for each team
    seen = seen.withColumn("n", F.row_number().over(order))
    fell = F.when(F.col("era") > 0, fixed["newcomer"] / F.col("n")).otherwise(0.0)
    seen = seen.withColumn("mean", fixed["start"] - F.sum(fell).over(order))
    before = F.coalesce(F.lag("mean").over(order), F.lit(fixed["start"]))
    teams = seen.select("league", "team", "era", "mean", "n", F.when(F.col("era") == 0, F.lit(fixed["start"])).otherwise(before - fixed["newcomer"]).alias("start"))
    teams = kept(teams)
    last = teams.groupBy("league", (F.col("era") + 1).alias("era")).agg(F.max_by("mean", "n").alias("mean"))
    filled = F.last("mean", ignorenulls=True).over(Window.partitionBy("league").orderBy("era"))
    means = seasons.join(last, ["league", "era"], "left").select("league", "era", "season", filled.alias("mean"))
    return teams.select("league", "team", "start"), means


def rate_pools(matches: DataFrame, elo: dict | None = None) -> DataFrame:
    """The values of rate(), folded in a task of its own for each pool of a league: teams that are linked by matches.

    What couples the pools of a league, the mean of all its teams, is worked out beforehand (see starts), so a league of many pools is
    spread over as many tasks. Seasons of a league must not overlap in time.
    """
    fixed = ELO | (elo or {})
    matches = matches.select(*_COLUMNS)
    node = lambda c: F.struct("league", F.col(c).alias("team"))
    pools = components(matches.select(node("home_team_id").alias("a"), node("away_team_id").alias("b")).distinct())
    pools = pools.select("node.league", "node.team", F.col("component.team").alias("pool"))
    teams, means = starts(matches, fixed)
    teams = kept(teams.join(pools, ["league", "team"]))
    eras = means.groupBy("league").agg(F.array_sort(F.collect_list(F.struct("era", "mean"))).alias("m"))  # a row for each season of a league
    eras = eras.select("league", F.transform("m", lambda x: x["mean"]).alias("means"))
    side = lambda s: teams.select("league", F.col("team").alias(f"{s}_team_id"), F.col("start").alias(f"{s}_start"), *([F.col("pool")] if s == "home" else []))
    rows = matches.join(means.select("league", "season", "era"), ["league", "season"]).join(eras, "league").join(side("home"), ["league", "home_team_id"]).join(side("away"), ["league", "away_team_id"])

    class Rated:
        def __init__(self):
            self.teams: dict[int, Known] = {}
            self.era = 0

        def eval(self, m: Row) -> Iterator[tuple]:
            for era in range(self.era + 1, m.era + 1):
                pull = (1 - fixed["carry"]) * m.means[era]
                self.teams = {t: (fixed["carry"] * e + pull, *pi) for t, (e, *pi) in self.teams.items()}
            self.era = m.era
            h = self.teams.get(m.home_team_id, (m.home_start, 0.0, 0.0))
            a = self.teams.get(m.away_team_id, (m.away_start, 0.0, 0.0))
            before, self.teams[m.home_team_id], self.teams[m.away_team_id] = step(h, a, m.home_score, m.away_score, fixed)
            yield m.match_id, *before

    fold = F.udtf(Rated, returnType=_SCHEMA)
    return _rounded(fold(rows.asTable().partitionBy("league", "pool").orderBy("match_date", "match_id")))


class Stream(StatefulProcessor):
    """The fold as state of a stream: a map from team to its numbers, and the season, for each league."""

    def __init__(self, fixed: dict):
        self.fixed = fixed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.teams = handle.getMapState("teams", "team long", "elo double, pi_home double, pi_away double")
        self.season = handle.getValueState("season", "season long, first long, match_date date, match_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        m = pd.concat(list(rows)).sort_values(["match_date", "match_id"])  # one batch of one league
        season, first, day, match = self.season.get() if self.season.exists() else (None, None, None, None)
        if day is not None and (m.match_date.iloc[0], m.match_id.iloc[0]) <= (day, match):
            raise ValueError(f"match {m.match_id.iloc[0]} of league {key[0]} arrives after match {match}, which is not before it")
        known = {k[0]: tuple(v) for k, v in self.teams.iterator()}
        league = League(self.fixed, season, first, known)
        out = [(r.match_id, *league.play(int(r.season), r.home_team_id, r.away_team_id, r.home_score, r.away_score)) for r in m.itertuples()]
        for t, v in league.teams.items():
            if known.get(t) != v:
                self.teams.updateValue((t,), v)
        self.season.update((league.season, league.first, m.match_date.iloc[-1], int(m.match_id.iloc[-1])))
        yield pd.DataFrame(out, columns=["match_id", *NUMBERS])

    def close(self) -> None:
        pass


def rate_stream(matches: DataFrame, elo: dict | None = None) -> DataFrame:
    """rate() over a stream of matches that arrive in order: each batch's rows are later than those before, else the query fails.

    The state is kept in the checkpoint, so a restarted stream goes on where it was. It needs the RocksDB state store.
    """
    rows = matches.select(*_COLUMNS)
    out = rows.groupBy("league").transformWithStateInPandas(Stream(ELO | (elo or {})), _SCHEMA, "Append", "None")
    return _rounded(out)
