"""Column functions: outcomes, odds, probabilities, and proper scores over the classes H, D, A in this order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def result(home: str, away: str) -> Column:
    return F.when(F.col(home) > F.col(away), "H").when(F.col(home) < F.col(away), "A").otherwise("D")


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(0.0)


def de_vig(h: str, d: str, a: str) -> tuple[Column, Column, Column, Column]:
    """Implied probabilities that sum to 1, and the over-round; null where a price is missing."""
    over = 1 / F.col(h) + 1 / F.col(d) + 1 / F.col(a)
    return *(1 / F.col(c) / over for c in (h, d, a)), over


def floored(ps: list[Column], least: float = 0.005) -> list[Column]:
    up = [F.greatest(p, F.lit(least)) for p in ps]
    return [p / sum(up[1:], up[0]) for p in up]


def rps(h: Column, d: Column, y: Column) -> Column:
    """Ranked probability score of one row."""
    oh, od = (y == "H").cast("int"), (y == "D").cast("int")
    return (F.pow(h - oh, 2) + F.pow(h + d - oh - od, 2)) / 2


def brier(h: Column, d: Column, a: Column, y: Column) -> Column:
    return sum((F.pow(p - (y == k).cast("int"), 2) for p, k in ((d, "D"), (a, "A"))), F.pow(h - (y == "H").cast("int"), 2))


def log_loss(h: Column, d: Column, a: Column, y: Column, eps: float = 1e-15) -> Column:
    p = F.when(y == "H", h).when(y == "D", d).otherwise(a)
    return -F.ln(clip(p, eps, 1 - eps))


def pick(h: Column, d: Column, a: Column) -> Column:
    """The most likely class; of equals the first."""
    return F.when((h >= d) & (h >= a), "H").when(d >= a, "D").otherwise("A")
