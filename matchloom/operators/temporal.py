"""As-of, tolerance and nearest joins; prefix snapshots; date splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.windows import running_max, top


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str, parts: int | None = None) -> DataFrame:
    """left with the value of the latest right row strictly before: one union, one shuffle, one window; no range join.

    right has one row for each key and date. left rows come before right rows of their date, so equal dates don't match.
    `parts` is the number of tasks that sort; without it Spark's setting holds, whatever the rows.
    """
    cols = left.columns
    both = left.withColumns({"_t": F.col(at), "_side": F.lit(0), "_v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(key, F.col(since).alias("_t"), F.lit(1).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    both = both.repartition(parts, key) if parts else both
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 0").select(*cols, value)


def nearest_join(left: DataFrame, right: DataFrame, key: str, at: str, days: int, id_col: str, other: str) -> DataFrame:
    """left with the nearest right row within `days`, null if none; ties by the right id. Right dates are spread over the
    dates they can match, so the join is an equi-join."""
    spread = right.withColumn("_d", F.explode(F.sequence(F.date_sub(F.col(f"r_{at}"), days), F.date_add(F.col(f"r_{at}"), days))))
    joined = left.join(spread.withColumnRenamed("_d", at), [key, at], "left")
    gap = F.abs(F.datediff(F.col(at), F.col(f"r_{at}")))
    return top(joined.withColumn("gap", gap), [id_col], [F.col("gap").asc_nulls_last(), F.col(other)])


def prefix_snapshots(events: DataFrame, step: int, last: int, recent: int) -> DataFrame:
    """(match, t, team): counts over all events up to minute t, and over those of the last `recent` minutes, both ends in.

    Minutes are repaired by a running maximum. Events are counted once in the cell of the first grid minute that holds
    them, and cells are summed over time; only the recent window spreads an event over the few minutes it counts in.
    """
    eff = events.withColumn("eff", running_max("minute", ["match_id"], ["idx"])).where(F.col("eff") <= last)
    shot = F.col("type") == "purchase"
    counts = {
        "events": F.lit(1), "shots": shot.cast("int"), "goals": (shot & (F.col("value") > 100)).cast("int"),
        "fouls": (F.col("type") == "error").cast("int"), "touches": (F.col("x") >= 80).cast("int"),
    }
    eff = eff.withColumns(counts).withColumn("first", (F.ceil(F.col("eff") / step) * step).cast("int"))
    cell = eff.groupBy("match_id", "team_id", F.col("first").alias("t")).agg(*[F.sum(c).alias(c) for c in counts])
    grid = eff.select("match_id", "team_id").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(last), F.lit(step))))
    w = Window.partitionBy("match_id", "team_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    total = grid.join(cell, ["match_id", "team_id", "t"], "left").withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in counts})
    upto = (F.floor((F.col("eff") + recent) / step) * step).cast("int")
    held = F.filter(F.sequence(F.col("first"), F.greatest(upto, F.col("first")), F.lit(step)), lambda t: (t <= last) & (t - F.col("eff") <= recent))
    late = eff.withColumn("t", F.explode(held)).groupBy("match_id", "team_id", "t")
    late = late.agg(*[F.sum(c).alias(f"recent_{c}") for c in ("events", "shots")])
    return total.join(late, ["match_id", "team_id", "t"], "left").na.fill(0, ["recent_events", "recent_shots"])


def date_split(df: DataFrame, date: str) -> DataFrame:
    """Whole dates into train, validation and test: 60, 20 and 20 in a hundred of the distinct dates, truncated."""
    dates = df.select(date).distinct()
    n = dates.count()
    a, b = int(n * 0.6), int(n * 0.8)
    ranks = dates.withColumn("_r", F.row_number().over(Window.orderBy(date)))  # a row for each calendar day
    split = F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "validation").otherwise("test")
    return df.join(ranks.select(date, split.alias("split")), date)
