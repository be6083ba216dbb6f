"""The normal distribution as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26 (an error of 1.5e-7 at most).
A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
P = 0.3275911


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + P * x)
    poly = t * (A[0] + t * (A[1] + t * (A[2] + t * (A[3] + t * A[4]))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def ordinal(margin: Column, theta: Column, sigma: Column) -> tuple[Column, Column, Column]:
    """Home, draw and away: the margin with normal error above theta, between, and below -theta."""
    above, below = 1 - normal_cdf((theta - margin) / sigma), normal_cdf((-theta - margin) / sigma)
    return above, 1 - above - below, below
