"""Discrete Gamma rate categories: equal-probability bins, the mean of each."""

from __future__ import annotations

from math import lgamma
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_LN_GAMMA = np.vectorize(lgamma, otypes=[float])
_NORMAL = np.vectorize(NormalDist().inv_cdf, otypes=[float])
#: Shapes from here on are integrated around the mean; below it series and fraction take some dozens of terms.
_WIDE_SHAPE = 20.0
#: Standard deviations around the mean beyond which nothing is left.
_REACH = 14.0
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(160)


def _by_terms(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A power series below shape + 1 and a continued fraction above it."""
    front = np.exp(shape * np.log(x) - x - _LN_GAMMA(shape))
    small = x < shape + 1
    step = np.where(small, x, 0.0)
    term = 1 / shape
    series = term.copy()
    for i in range(1, 2000):
        term = term * step / (shape + i)
        series += term
        if np.all(term < 1e-17 * series):
            break
    else:
        raise ArithmeticError("the series of the incomplete gamma function did not converge")
    z = np.where(small, shape + 2, x)
    b = z + 1 - shape
    c, d = np.full_like(b, 1e300), 1 / b
    h = d.copy()
    for i in range(1, 2000):
        a = -i * (i - shape)
        b = b + 2
        d = 1 / (a * d + b)
        c = b + a / c
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 4e-16):
            break
    else:
        raise ArithmeticError("the continued fraction of the incomplete gamma function did not converge")
    return np.where(small, front * series, 1 - front * h)


def _height(shape: np.ndarray, step: np.ndarray) -> np.ndarray:
    """x^shape e^-x / Gamma(shape) at x = shape (1 + step), for wide shapes.

    Stirling's series takes the large parts of both logarithms out, so that the
    relative error stays near that of ``step`` for every shape.
    """
    one = 1 / shape
    rest = one / 12 - one**3 / 360 + one**5 / 1260 - one**7 / 1680
    step = np.maximum(step, -1 + 1e-15)
    return np.sqrt(shape / (2 * np.pi)) * np.exp(shape * (np.log1p(step) - step) - rest)


def _by_integral(shape: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The lower part up to x = shape (1 + step): Gauss-Legendre over the distance from the mean, uniform in the shape."""
    reach = _REACH / np.sqrt(shape)
    low = np.maximum(-reach, -1.0)
    high = np.clip(step, low, reach)
    half = (high - low) / 2
    at = low[..., None] + half[..., None] * (_NODES + 1)
    inside = _height(shape[..., None], at) / np.maximum(1 + at, 1e-15)
    return np.minimum((inside * _WEIGHTS).sum(-1) * half, 1.0)


def lower_gamma(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function of arrays of equal shape."""
    shape = np.asarray(shape, dtype=float)
    x = np.maximum(np.asarray(x, dtype=float), 1e-300)
    out = np.empty(shape.shape)
    wide = shape >= _WIDE_SHAPE
    out[wide] = _by_integral(shape[wide], x[wide] / shape[wide] - 1)
    out[~wide] = _by_terms(shape[~wide], x[~wide])
    return out


def _solve(start: np.ndarray, low: np.ndarray, high: np.ndarray, shape: np.ndarray, p: np.ndarray, value, slope) -> np.ndarray:
    """Newton steps on functions of (shape, x) that increase with x, halved where they leave the bracket."""
    out = np.clip(start, low, high)
    low, high = low.copy(), high.copy()
    left = np.arange(len(out))  # not settled yet
    for _ in range(200):
        at, a = out[left], shape[left]
        gap = value(a, at) - p[left]
        under = gap < 0
        low[left[under]], high[left[~under]] = at[under], at[~under]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            following = at - gap / slope(a, at)
        lost = ~np.isfinite(following) | (following < low[left]) | (following > high[left])
        following = np.where(lost, (low[left] + high[left]) / 2, following)
        out[left] = following
        left = left[(np.abs(following - at) > 1e-14 * np.abs(at)) & (np.abs(gap) > 4e-16)]
        if not len(left):
            break
    return out


def _wide_steps(shape: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Quantiles of wide shapes as distances from the mean: x = shape (1 + step)."""
    reach = _REACH / np.sqrt(shape)
    start = (1 - 1 / (9 * shape) + _NORMAL(p) / (3 * np.sqrt(shape))) ** 3 - 1
    return _solve(
        start, np.maximum(-reach, -1 + 1e-12), reach, shape, p, _by_integral, lambda a, s: _height(a, s) / (1 + s)
    )


def _narrow_logs(shape: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Quantiles of other shapes as logarithms; below 1e-300 they stay there."""
    cube = 1 - 1 / (9 * shape) + _NORMAL(p) / (3 * np.sqrt(shape))
    near_zero = (np.log(p) + _LN_GAMMA(shape + 1)) / shape  # the first term of the series alone
    start = np.where((cube > 0.1) & (shape > 0.3), np.log(shape) + 3 * np.log(np.maximum(cube, 0.1)), near_zero)
    low, high = np.full(shape.shape, np.log(1e-300)), np.full(shape.shape, np.log(1e4))
    return _solve(
        start, low, high, shape, p, lambda a, y: _by_terms(a, np.exp(y)), lambda a, y: np.exp(a * y - np.exp(y) - _LN_GAMMA(a))
    )


def category_rates(alphas: np.ndarray, n: int) -> np.ndarray:
    """Means of the n equal-probability bins of Gammas with mean 1: one row per shape."""
    alphas = np.asarray(alphas, dtype=float)
    if not len(alphas):
        return np.empty((0, n))
    shape = np.repeat(alphas[:, None], n - 1, axis=1)
    goal = np.broadcast_to(np.arange(1, n) / n, shape.shape)
    # the share of the mean below a quantile x is P(a + 1, x) = P(a, x) - x^a e^-x / Gamma(a + 1)
    edges = goal.copy()
    wide = shape >= _WIDE_SHAPE
    if wide.any():
        a = shape[wide]
        edges[wide] -= _height(a, _wide_steps(a, goal[wide])) / a
    if not wide.all():
        a = shape[~wide]
        edges[~wide] = _by_terms(a + 1, np.exp(_narrow_logs(a, goal[~wide])))
    ends = np.ones((len(alphas), 1))
    return n * np.diff(np.hstack([0 * ends, edges, ends]), axis=1)


def gamma_rates(draws: DataFrame, alpha: Column, n: int) -> DataFrame:
    """Explode every draw into its rate categories: columns cat, rate and w = 1/n."""

    @F.pandas_udf("array<double>")
    def rates(alphas: pd.Series) -> pd.Series:
        shapes = alphas.dropna().unique()
        known = dict(zip(shapes, category_rates(shapes, n), strict=True))
        return alphas.map(known.get)

    return draws.select("*", F.posexplode(rates(alpha)).alias("cat", "rate")).withColumn("w", F.lit(1.0 / n))
