"""Data contracts: joins that check their keys, and tables of checks with their violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, validate: str) -> DataFrame:
    """A join that raises ValueError where keys repeat on a side that `validate` (one_to_one, many_to_one) says is unique."""
    sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}[validate]
    for side in sides:
        if not duplicates(side, keys).isEmpty():
            raise ValueError(f"join is not {validate}: keys {keys} repeat")
    return left.join(right, keys, how)


def expect(df: DataFrame, checks: dict[str, Column], strict: bool = False) -> DataFrame:
    """(check, violations) of row checks in one pass; with strict, ValueError if any is violated. Null counts as violated."""
    bad = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    out = bad.unpivot([], list(checks), "check", "violations")
    if strict and (found := [tuple(r) for r in out.where("violations > 0").collect()]):
        raise ValueError(f"violated: {found}")
    return out


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
