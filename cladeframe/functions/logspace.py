"""Averages of likelihoods kept on the log scale, in one mergeable pass.

Values are grouped by ``floor(x / 256)``. Inside such a band ``exp(x - 256 band)``
and its square stay in double range, so plain sums with map-side partial
aggregation are enough, and the bands of a key are combined afterwards. No pass
for the maximum and no join back is needed, and the same sums work on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND = 256.0


def band(x: Column) -> Column:
    """The band of a value; minus infinity, a likelihood of zero, is in a band below all others."""
    return F.floor(F.greatest(x, F.lit(-1e12)) / BAND)


def band_sums(x: Column) -> list[Column]:
    """Aggregates to take per (keys, band)."""
    up = x - BAND * band(x)
    return [
        F.count(x).alias("_n"),
        F.avg(x).alias("_mean"),
        F.var_pop(x).alias("_var"),
        F.sum(F.exp(up)).alias("_p1"),
        F.sum(F.exp(2 * up)).alias("_p2"),
        F.sum(F.exp(-up)).alias("_m1"),
        F.sum(F.exp(-2 * up)).alias("_m2"),
    ]


def combine_bands(bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge the bands of every key.

    Columns: ``n``, ``mean``, ``var`` (population), ``log_mean_exp`` with its
    importance ``ess`` and ``log_harmonic`` (minus log mean exp(-x)) with
    ``ess_harmonic``.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    b = F.col("_band")
    hi = F.col("_bmax")
    lo = F.col("_bmin")
    n = F.sum("_n")
    rise = F.exp(BAND * (b - hi))
    fall = F.exp(BAND * (lo - b))
    p1 = F.sum(F.col("_p1") * rise)
    p2 = F.sum(F.col("_p2") * rise * rise)
    m1 = F.sum(F.col("_m1") * fall)
    m2 = F.sum(F.col("_m2") * fall * fall)
    total = F.sum(F.col("_n") * F.col("_mean")).over(w) / F.sum("_n").over(w)
    return (
        bands.withColumn("_bmax", F.max(b).over(w))
        .withColumn("_bmin", F.min(b).over(w))
        .withColumn("_all", total)
        .groupBy(*keys)
        .agg(
            n.alias("n"),
            F.first("_all").alias("mean"),
            (F.sum(F.col("_n") * (F.col("_var") + F.pow(F.col("_mean") - F.col("_all"), 2))) / n).alias("var"),
            F.when(p1 > 0, F.log(p1 / n) + BAND * F.max("_bmax")).otherwise(float("-inf")).alias("log_mean_exp"),
            F.try_divide(p1 * p1, p2).alias("ess"),
            (BAND * F.min("_bmin") - F.log(m1 / n)).alias("log_harmonic"),
            F.try_divide(m1 * m1, m2).alias("ess_harmonic"),
        )
    )


def log_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All log-scale averages of ``value`` per key (see :func:`combine_bands`)."""
    x = F.col(value)
    bands = df.groupBy(*keys, band(x).alias("_band")).agg(*band_sums(x))
    return combine_bands(bands, keys)


def weighted_log_sums(df: DataFrame, keys: Sequence[str], value: str, weights: dict[str, Column]) -> DataFrame:
    """log of the weighted sum of exp(value) per key, one column per entry of ``weights``.

    A sum of zero is minus infinity; the key stays.
    """
    keys = list(keys)
    x = F.col(value)
    w = Window.partitionBy(*keys)
    sums = [F.sum(weight * F.exp(x - BAND * F.col("_band"))).alias(f"_s_{name}") for name, weight in weights.items()]
    bands = df.withColumn("_band", band(x)).groupBy(*keys, "_band").agg(*sums)
    some = F.greatest(*[F.col(f"_s_{n}") for n in weights]) if len(weights) > 1 else F.col(f"_s_{next(iter(weights))}")
    bands = bands.withColumn("_some", some > 0).withColumn("_bmax", F.max(F.when(F.col("_some"), F.col("_band"))).over(w))
    rise = F.exp(BAND * (F.col("_band") - F.col("_bmax")))
    out = []
    for name in weights:
        total = F.sum(F.when(F.col("_some"), F.col(f"_s_{name}") * rise))
        out.append(F.when(total > 0, F.log(total) + BAND * F.max("_bmax")).otherwise(float("-inf")).alias(name))
    return bands.groupBy(*keys).agg(*out)


def weighted_log_sum(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """log of the weighted sum of exp(value) per key."""
    return weighted_log_sums(df, keys, value, {name: F.col(weight)})
