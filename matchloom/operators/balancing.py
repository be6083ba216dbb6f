"""Rows that even out classes: neighbours from ordered windows, draws from hashes, geometry in columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(tag: str, *cols: str) -> Column:
    """A number of 32 bits from the columns and a tag."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(tag), *cols)), 1, 8), 16, 10).cast("long")


def uniform(tag: str, *cols: str) -> Column:
    return draw(tag, *cols) / 4294967296.0


def neighbours(keys: list[str], x: str, row_id: str, fields: list[str], reach: int, distance, keep=None) -> Column:
    """The rows at most `reach` places away in the order of x within the keys, nearest first: (distance, id, fields).

    With `distance` in x alone the first `reach` of them are the exact nearest ones, as no nearer row can lie further off in the order.
    """
    w = Window.partitionBy(*keys).orderBy(x, row_id).rowsBetween(-reach, reach)
    near = F.collect_list(F.struct(F.col(row_id).alias("id"), *fields)).over(w)
    others = F.filter(near, lambda e: (e["id"] != F.col(row_id)) & (keep(e) if keep else F.lit(True)))
    return F.array_sort(F.transform(others, lambda e: F.struct(distance(e).alias("d"), e["id"].alias("id"), *[e[c].alias(c) for c in fields])))


def short_of(rows: DataFrame, cell: list[str], label: str) -> DataFrame:
    """rows with n, the size of their class in the cell, and need, what it lacks to the largest class there."""
    sizes = rows.groupBy(*cell, label).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("need", F.max("n").over(Window.partitionBy(*cell)) - F.col("n"))
    return rows.join(sizes, [*cell, label])


def even_share(need: Column, rank: Column, n: Column) -> Column:
    """`need` copies over n rows, the first ones by rank getting what does not divide."""
    return F.floor(need / n) + F.when(rank <= need % n, 1).otherwise(0)


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row as often as `times` says, with the number of its copy from 0."""
    return rows.withColumn("_t", times.cast("long")).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_t") - 1))).drop("_t")


def snapped(a: Column, b: Column, u: Column, categories: list[int]) -> Column:
    """The category of the largest part in a one-hot row between those of a and b; of equals the first."""
    part = F.transform(F.array(*map(F.lit, categories)), lambda c: (1 - u) * (a == c).cast("double") + u * (b == c).cast("double"))
    return F.get(F.array(*map(F.lit, categories)), (F.array_position(part, F.array_max(part)) - 1).cast("int"))


def in_disc(c: tuple[Column, Column], s: tuple[Column, Column], angle: Column, radius: Column, truncation: float, deformation: float) -> tuple[Column, Column, Column]:
    """A point of the disc round c that s lies on, and the disc's radius.

    angle and radius (0 to 1) name a point of the unit disc. Truncation 1 leaves the half towards s, -1 the other, 0 all;
    deformation draws the disc towards the line through s. Where s is c, the point is c.
    """
    dx, dy = s[0] - c[0], s[1] - c[1]
    size = F.sqrt(dx * dx + dy * dy)
    ex, ey = F.when(size > 0, dx / size).otherwise(0.0), F.when(size > 0, dy / size).otherwise(0.0)
    vx, vy = radius * F.cos(2 * math.pi * angle), radius * F.sin(2 * math.pi * angle)
    along = vx * ex + vy * ey
    flip = F.when(F.abs(truncation - along) > 1, 2.0).otherwise(0.0)
    vx, vy = vx - flip * along * ex, vy - flip * along * ey
    along = vx * ex + vy * ey
    vx, vy = vx - deformation * (vx - along * ex), vy - deformation * (vy - along * ey)
    return c[0] + size * vx, c[1] + size * vy, size


def mode(values: Column) -> Column:
    """The most frequent value of an array, of equals the smallest; null for an empty one."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda o: o == v))).alias("n"), v.alias("v")))
    return F.get(F.array_sort(counted), F.lit(0))["v"]
