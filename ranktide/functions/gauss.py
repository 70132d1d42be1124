"""The normal distribution, as columns and on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of a well-known rational fit of erfc, good to some 1e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def two_sided(z: Column) -> Column:
    """2 (1 - Phi(|z|)) = erfc(|z| / sqrt 2)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.5 * x)
    s = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        s = F.lit(c) + t * s
    return t * F.exp(-x * x + s)


def upper(z: Column) -> Column:
    """1 - Phi(z)."""
    return F.when(z >= 0, 0.5 * two_sided(z)).otherwise(1.0 - 0.5 * two_sided(z))
