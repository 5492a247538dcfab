"""Closed-form statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(successes: Column, n: Column, z: float = Z) -> Column:
    """struct<low,high>: Wilson score interval, (0, 1) where n is 0."""
    n = n.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z / 2), n)) / scale
    half = z / scale * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    high = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)
    return F.struct(low.alias("low"), high.alias("high"))


def student_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation r over n pairs: Student's t with n - 2 degrees of freedom, by its
    finite trigonometric series. Null where r is null or n < 3; 0 where |r| is 1."""
    v = (n - 2).cast("int")
    theta = F.atan(F.abs(r) / F.sqrt(F.greatest(1 - r * r, F.lit(1e-300))))
    c, s = F.cos(theta), F.sin(theta)
    odd = F.pmod(v, F.lit(2)) == 1
    # terms of 1, c^2, c^4 ... with factors (k-1)/k (even degrees) or k/(k+1) (odd degrees) for k = 2, 4 ...
    steps = F.when(v >= 4, F.sequence(F.lit(1), F.floor((v - 2) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, k: Column) -> Column:
        factor = F.when(odd, (2.0 * k) / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
        term = a["term"] * factor * c * c
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    odd_steps = F.when(v >= 5, F.sequence(F.lit(1), F.floor((v - 3) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(F.when(odd, odd_steps).otherwise(steps), state, step, lambda a: a["sum"])
    inside = F.when(v == 1, 2 * theta / math.pi).when(odd, 2 / math.pi * (theta + s * c * total)).otherwise(s * total)
    p = F.greatest(F.lit(0.0), 1 - inside)
    return F.when(r.isNull() | (n < 3), F.lit(None).cast("double")).when(F.abs(r) >= 1, 0.0).otherwise(p)
