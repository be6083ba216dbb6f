"""Prior-only windows, ranks and pivots over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prior(keys: list[str], order: list[str], n: int | None = None):
    """The n rows before each row (all, if None); order must be unique within the keys."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def prior_mean(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str], n: int) -> DataFrame:
    """cols {new: old}: means over the n rows before; null on a key's first row."""
    return df.withColumns({new: F.avg(old).over(prior(keys, order, n)) for new, old in cols.items()})


def top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, slot: str | None = None) -> DataFrame:
    """The first n rows of each key; with slot, their number."""
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n)
    return out.withColumnRenamed("_n", slot) if slot else out.drop("_n")


def running_max(col: str, keys: list[str], order: list[str]) -> Column:
    """The largest value so far: repairs a clock that falls back."""
    return F.max(col).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def home_away(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Two rows of a match to one: home_*, away_* and diff_* in one shuffle."""
    side = lambda c, v: F.max(F.when(F.col("venue") == v, F.col(c))).alias(f"{v}_{c}")
    wide = df.groupBy(key).agg(*[side(c, v) for c in cols for v in ("home", "away")])
    return wide.withColumns({f"diff_{c}": F.col(f"home_{c}") - F.col(f"away_{c}") for c in cols})
