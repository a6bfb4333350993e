"""Two-sided 95 % critical values of Student's t for any number of degrees of freedom."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = 1.959963984540054
#: Beyond this the first terms of the expansion in 1 / df are exact to double precision.
_LARGE = 200_000


def _two_sided(t: float, df: int) -> float:
    """P(|T| <= t) for integer df: a finite trigonometric sum."""
    theta = np.arctan(t / np.sqrt(df))
    c2 = np.cos(theta) ** 2
    if df % 2:
        j = np.arange(1, (df - 1) // 2)
        terms = np.cumprod(np.r_[1.0, 2 * j / (2 * j + 1) * c2]) if df > 1 else np.zeros(1)
        return float(2 / np.pi * (theta + (np.sin(theta) * np.cos(theta) * terms.sum() if df > 1 else 0.0)))
    j = np.arange(1, df // 2)
    terms = np.cumprod(np.r_[1.0, (2 * j - 1) / (2 * j) * c2])
    return float(np.sin(theta) * terms.sum())


def critical_value(df: int, level: float = 0.95) -> float:
    """Newton steps from the normal quantile; the curve is concave, so they rise to the root."""
    if df > _LARGE and level == 0.95:
        z = _NORMAL
        return z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
    log_front = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    t = _NORMAL
    for _ in range(200):
        density = 2 * math.exp(log_front - (df + 1) / 2 * math.log1p(t * t / df))
        step = (level - _two_sided(t, df)) / density
        t += step
        if abs(step) < 1e-13 * t:
            break
    return t


def t95(df: Column) -> Column:
    """Critical value of every row's degrees of freedom; null below one."""

    @F.pandas_udf("double")
    def values(numbers: pd.Series) -> pd.Series:
        known = {d: critical_value(int(d)) for d in numbers.dropna().unique() if d >= 1}
        return numbers.map(known.get).astype(float)

    return values(df.cast("bigint"))
