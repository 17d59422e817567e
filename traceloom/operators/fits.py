"""Least squares on sums of moments: one pass, a row of sums a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _det(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def quadratic(df: DataFrame, group: list[str], x: Column, y: Column, centre: float = 0.0) -> DataFrame:
    """group, n, c2, c1, c0 of the parabola that fits y best. Moments are taken about `centre`, which should lie among the x, as
    sums of high powers lose digits. Groups with fewer than three different x have null coefficients."""
    u = x - centre
    power = lambda k: F.sum(F.pow(u, F.lit(k)))
    sums = df.where(x.isNotNull() & y.isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), *(power(k).alias(f"_s{k}") for k in range(1, 5)), *(F.sum(F.pow(u, F.lit(k)) * y).alias(f"_t{k}") for k in range(3)))
    s, t = [F.col("n").cast("double"), *(F.col(f"_s{k}") for k in range(1, 5))], [F.col(f"_t{k}") for k in range(3)]
    m = [[s[i + j] for j in range(3)] for i in range(3)]
    det = _det(m)
    solved = [_det([[t[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / F.when(F.abs(det) > 1e-9 * s[0] * s[2] * s[4], det) for k in range(3)]
    b0, b1, b2 = (F.col(f"_b{k}") for k in range(3))
    out = sums.select("*", *(c.alias(f"_b{k}") for k, c in enumerate(solved)))
    return out.select(*group, "n", b2.alias("c2"), (b1 - 2 * centre * b2).alias("c1"), (b0 - centre * b1 + centre * centre * b2).alias("c0"))


def line(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
