"""Moment expressions over grouped rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment_columns(x: str, y: str) -> list[Column]:
    """Population and unbiased variance, covariance and correlation of two columns."""
    return [
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
        F.var_pop(x).alias("var_x"),
        F.var_samp(x).alias("unbiased_var_x"),
        F.covar_pop(x, y).alias("covar"),
        F.corr(x, y).alias("correl"),
    ]


def dot_entropy(freqs: Column) -> Column:
    """Entropy of an array of frequencies; zero terms count as zero."""
    return F.aggregate(freqs, F.lit(0.0), lambda acc, f: acc - F.when(f > 0, f * F.log(f)).otherwise(0.0))


def shares(counts: Column) -> Column:
    """Counts array to frequencies; null when nothing was counted."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c)
    return F.when(total > 0, F.transform(counts, lambda c: c / total))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))
