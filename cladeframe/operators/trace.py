"""Burn-in, moments, autocorrelation, effective size and run comparison of traces.

``trace(run, iter, param, value)`` is long; ``iter`` counts from 0 inside a run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cladeframe.functions.ordered import order_statistics
from cladeframe.session import durable

SERIES = ["run", "param"]
# A series up to this length is transformed by one task; a longer one is split.
SHORT_SERIES = 1 << 16


def thin(df: DataFrame, burnin: int, every: int = 1, until: int | None = None) -> DataFrame:
    """Keep points with burnin <= iter < until, every ``every``-th of them."""
    kept = df.filter(F.col("iter") >= burnin)
    if until is not None:
        kept = kept.filter(F.col("iter") < until)
    return kept.filter((F.col("iter") - F.lit(burnin)) % F.lit(every) == 0) if every > 1 else kept


def default_window(n: int, burnin: int = -1, until: int = -1) -> tuple[int, int]:
    """Resolve the defaults for a chain of ``n`` points: until = n, burnin = n / 5 (or n / k for -k)."""
    until = n if until < 0 or until > n else until
    if burnin == -1:
        burnin = until // 5
    elif burnin < -1:
        burnin = until // -burnin
    return burnin, until


def thin_trees(trees: DataFrame, burnin: int = -1, every: int = 1, until: int | None = None) -> DataFrame:
    """Thin every run of a tree list; a burn-in of -1 is n/5, of -k is n/k, n being the run's size."""
    sizes = trees.groupBy("run").agg((F.max("iter") + 1).alias("_n"))
    if until is not None:
        sizes = sizes.withColumn("_n", F.least(F.col("_n"), F.lit(until)))
    share = 5 if burnin == -1 else -burnin
    start = F.floor(F.col("_n") / share) if burnin < 0 else F.lit(burnin)
    return (
        trees.join(sizes.withColumn("_start", start), "run")
        .filter((F.col("iter") >= F.col("_start")) & (F.col("iter") < F.col("_n")))
        .filter((F.col("iter") - F.col("_start")) % F.lit(every) == 0)
        .drop("_n", "_start")
    )


def align_traces(trace: DataFrame, burnin: int = -1, until: int | None = None) -> DataFrame:
    """Trim all runs to the shortest one, drop the burn-in (-1: a fifth) and renumber from 0."""
    if burnin < -1:
        raise ValueError("a burn-in is a number of points, or -1 for a fifth of them")
    longest = trace.groupBy("run").agg((F.max("iter") + 1).alias("_n"))
    size = longest.agg(F.min("_n").alias("_n"))
    if until is not None:
        size = size.select(F.least(F.col("_n"), F.lit(until)).alias("_n"))
    start = F.floor(F.col("_n") / 5) if burnin == -1 else F.lit(burnin)
    limits = size.select(F.struct("_n", start.cast("bigint").alias("_start")).alias("_l")).scalar()
    return (
        trace.filter((F.col("iter") >= limits["_start"]) & (F.col("iter") < limits["_n"]))
        .withColumn("iter", F.col("iter") - limits["_start"])
    )


def trace_moments(trace: DataFrame) -> DataFrame:
    """n, mean, sample variance and constancy of every series."""
    return trace.groupBy(*SERIES).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.var_samp("value").alias("variance"),
        (F.min("value") == F.max("value")).alias("is_constant"),
    )


def _lagged_sums(values: np.ndarray, n_lags: int) -> np.ndarray:
    """sum over i of y_i y_(i+t), t < n_lags, for centred values."""
    size = 1 << int(np.ceil(np.log2(max(2, len(values) + n_lags))))
    spectrum = np.fft.rfft(values, size)
    return np.fft.irfft(spectrum.real**2 + spectrum.imag**2, size)[:n_lags]


def series_blocks(trace: DataFrame, size: int = SHORT_SERIES) -> DataFrame:
    """(run, param, block, values, n, mean, variance, low, high): ``size`` points in order are one array.

    The trace is read and shuffled once; the statistics of a series are then taken from
    its blocks, which for all but long series is one.
    """
    points = F.array_sort(F.collect_list(F.struct("iter", "value")))
    return durable(
        trace.groupBy(*SERIES, F.floor(F.col("iter") / size).alias("block")).agg(
            F.transform(points, lambda p: p["value"]).alias("values"), F.count("value").alias("n"), F.avg("value").alias("mean"),
            F.var_samp("value").alias("variance"), F.min("value").alias("low"), F.max("value").alias("high"),
        )
    )


def _by_length(blocks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Series of one block, and the blocks of the others where there are any."""
    if blocks.filter("block > 0").isEmpty():
        return blocks, None
    long = blocks.filter("block > 0").select(*SERIES).distinct()
    return blocks.join(long, SERIES, "left_anti"), blocks.join(long, SERIES, "left_semi")


def _points(blocks: DataFrame, size: int) -> DataFrame:
    """The trace again."""
    listed = blocks.select(*SERIES, "block", F.posexplode("values").alias("_at", "value"))
    return listed.select(*SERIES, (F.col("block") * size + F.col("_at")).alias("iter"), "value")


def block_moments(blocks: DataFrame) -> DataFrame:
    """The moments of :func:`trace_moments` from blocks: means and squares of the blocks add up."""
    squares = F.coalesce(F.col("variance"), F.lit(0.0)) * (F.col("n") - 1)
    total = blocks.groupBy(*SERIES).agg(
        F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"),
        F.sum(squares).alias("_within"), F.collect_list(F.struct("n", "mean")).alias("_parts"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    between = F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return total.select(
        *SERIES, "n", "mean", F.when(F.col("n") > 1, (F.col("_within") + between) / (F.col("n") - 1)).alias("variance"),
        (F.col("low") == F.col("high")).alias("is_constant"),
    )


def _centred_sums(y: np.ndarray) -> np.ndarray:
    y = np.asarray(y, dtype=float)
    return _lagged_sums(y - y.mean(), len(y) // 2) if len(y) else np.zeros(0)


@F.pandas_udf(ArrayType(DoubleType()))
def _lagged(series: pd.Series) -> pd.Series:
    return series.map(_centred_sums)


def _size_of(y: np.ndarray) -> float:
    """n / (1 + 2 sum of w_t rho_t) of one series."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    sums = _centred_sums(y)
    if n < 2 or y.min() == y.max():
        return float(n)
    t = np.arange(1, len(sums))
    inflation = 1 + 2 * (0.5 * (1 + np.cos(2 * np.pi * t / n)) * sums[1:]).sum() / (y.var(ddof=1) * (n - 1))
    return float(n) if inflation < 1 else n / inflation


@F.pandas_udf(DoubleType())
def _sizes(series: pd.Series) -> pd.Series:
    return series.map(_size_of)


def _columns_first(pdf: pd.DataFrame) -> pd.DataFrame:
    """Transform of one residue class j2 of a long series, with the twiddle factors."""
    first = pdf.iloc[0]
    n1, n2, j2 = int(first.n1), int(first.n2), int(first.j2)
    x = np.zeros(n1)
    x[pdf["j1"].to_numpy()] = pdf["y"].to_numpy()
    a = np.fft.fft(x) * np.exp(-2j * np.pi * j2 * np.arange(n1) / (n1 * n2))
    return pd.DataFrame(
        {"run": first.run, "param": first.param, "n": first.n, "n1": n1, "n2": n2,
         "k1": np.arange(n1), "j2": j2, "re": a.real, "im": a.imag}
    )


def _power_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Finish the transform for one k1, take the power and begin the way back."""
    first = pdf.iloc[0]
    n1, n2, k1 = int(first.n1), int(first.n2), int(first.k1)
    a = np.zeros(n2, dtype=complex)
    a[pdf["j2"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
    power = np.abs(np.fft.fft(a)) ** 2
    b = np.fft.ifft(power) * np.exp(2j * np.pi * k1 * np.arange(n2) / (n1 * n2))
    return pd.DataFrame(
        {"run": first.run, "param": first.param, "n": first.n, "n1": n1, "n2": n2,
         "t2": np.arange(n2), "k1": k1, "re": b.real, "im": b.imag}
    )


def _lag_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf.iloc[0]
    n1, n2, t2 = int(first.n1), int(first.n2), int(first.t2)
    b = np.zeros(n1, dtype=complex)
    b[pdf["k1"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
    lags = t2 + n2 * np.arange(n1)
    keep = lags < int(first.n) // 2
    return pd.DataFrame({"run": first.run, "param": first.param, "lag": lags[keep], "s": np.fft.ifft(b).real[keep]})


def _long_lagged_sums(centred: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Lagged sums of long series in three shuffles.

    The zero-padded length n1 * n2 is a power of two; the transform is done over
    residue classes and then over rows, so a task holds about the square root of a
    series, and the same two steps bring the power spectrum back to lags.
    """
    run, param = schema["run"], schema["param"]
    ids = f"run {run}, param {param}, n bigint, n1 bigint, n2 bigint"
    bits = F.ceil(F.log2(F.col("n") + F.floor(F.col("n") / 2))).cast("int")
    laid_out = (
        centred.withColumn("_bits", bits)
        .withColumn("n1", F.expr("shiftleft(1L, cast(_bits div 2 as int))"))
        .withColumn("n2", F.expr("shiftleft(1L, cast(_bits - _bits div 2 as int))"))
        .select("run", "param", "n", "n1", "n2", F.floor(F.col("iter") / F.col("n2")).alias("j1"), (F.col("iter") % F.col("n2")).alias("j2"), "y")
    )
    first = laid_out.groupBy("run", "param", "j2").applyInPandas(_columns_first, f"{ids}, k1 bigint, j2 bigint, re double, im double")
    power = first.groupBy("run", "param", "k1").applyInPandas(_power_rows, f"{ids}, t2 bigint, k1 bigint, re double, im double")
    return power.groupBy("run", "param", "t2").applyInPandas(_lag_rows, f"run {run}, param {param}, lag bigint, s double")


def _long_sums(blocks: DataFrame, moments: DataFrame, size: int) -> DataFrame:
    """(run, param, lag, s) of series of many blocks that are not constant."""
    centred = _points(blocks, size).join(moments.filter(~F.col("is_constant")), SERIES).select(
        *SERIES, "n", "iter", (F.col("value") - F.col("mean")).alias("y")
    )
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    return _long_lagged_sums(centred, types)


def autocorrelation(trace: DataFrame, short: int = SHORT_SERIES) -> DataFrame:
    """(run, param, n, lag, autocov, rho) for lags below n // 2; autocov divides by n at every lag.

    A constant series has zero covariance and zero rho. ``iter`` must run from 0
    without gaps inside a series.
    """
    blocks = series_blocks(trace, short)
    one, many = _by_length(blocks)
    moving = one.filter("low < high").select(*SERIES, "n", "variance", F.posexplode(_lagged("values")).alias("lag", "s"))
    moving = moving.select(*SERIES, "n", "variance", F.col("lag").cast("bigint").alias("lag"), "s")
    moments = block_moments(blocks)
    if many is not None:
        sums = _long_sums(many, moments, short)
        moving = moving.unionByName(sums.join(moments, SERIES).select(*moving.columns))
    rows = moving.select(
        *SERIES, "n", "lag", (F.col("s") / F.col("n")).alias("autocov"), (F.col("s") / (F.col("variance") * (F.col("n") - 1))).alias("rho")
    )
    flat = moments.filter(F.col("is_constant") & (F.col("n") >= 2)).select(
        *SERIES, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / 2) - 1)).alias("lag"),
        F.lit(0.0).alias("autocov"), F.lit(0.0).alias("rho"),
    )
    return rows.unionByName(flat)


def _long_sizes(many: DataFrame, moments: DataFrame, size: int) -> DataFrame:
    """ESS of series of many blocks."""
    wanted = moments.join(many.select(*SERIES).distinct(), SERIES, "left_semi")
    weight = 0.5 * (1 + F.cos(2 * np.pi * F.col("lag") / F.col("n")))
    rho = F.col("s") / (F.col("variance") * (F.col("n") - 1))
    spread = _long_sums(many, wanted, size).filter("lag > 0").join(wanted, SERIES).groupBy(*SERIES).agg(F.sum(weight * rho).alias("_s"))
    inflation = 1 + 2 * F.coalesce(F.col("_s"), F.lit(0.0))
    return wanted.join(spread, SERIES, "left").select(
        *SERIES, F.when(inflation < 1, F.col("n").cast("double")).otherwise(F.col("n") / inflation).alias("ess")
    )


def effective_size(trace: DataFrame, short: int = SHORT_SERIES) -> DataFrame:
    """n / (1 + 2 sum of w_t rho_t), w_t = (1 + cos(2 pi t / n)) / 2, and n when the sum is below 1."""
    blocks = series_blocks(trace, short)
    one, many = _by_length(blocks)
    sizes = one.select(*SERIES, _sizes("values").alias("ess"))
    return sizes if many is None else sizes.unionByName(_long_sizes(many, block_moments(blocks), short))


def credible_interval(trace: DataFrame, c: float = 0.95, keys: list[str] | None = None) -> DataFrame:
    """Order statistics int((1-c)n/2) and int(n - (1-c)n/2) - 1 of every series; c = 1 is the range."""
    half = 0.5 * (1 - c)
    n = F.col("n")
    ranks = {"ci_low": F.floor(half * n), "ci_high": F.floor(n - half * n) - 1}
    return order_statistics(trace, keys or SERIES, "value", ranks).select(*(keys or SERIES), "ci_low", "ci_high")


def trace_ci(trace: DataFrame, tail: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Mean and the values at sorted positions int(n tail) and int(n (1 - tail))."""
    keys = keys or SERIES
    n = F.col("n")
    ranks = {"ci_low": F.floor(n * F.lit(tail)), "ci_high": F.least(F.floor(n * F.lit(1 - tail)), n - 1)}
    means = trace.groupBy(*keys).agg(F.avg("value").alias("mean"))
    return means.join(order_statistics(trace, keys, "value", ranks), keys).select(*keys, "mean", "ci_low", "ci_high")


def trace_report(trace: DataFrame, c: float = 0.95, short: int = SHORT_SERIES) -> DataFrame:
    """mean, sd, se = sqrt(variance / ESS), ESS and credible interval of every series.

    A series of one block is reported from its array; longer ones go through the split
    transform and bucketed order statistics.
    """
    blocks = series_blocks(trace, short)
    one, many = _by_length(blocks)
    half, n = 0.5 * (1 - c), F.col("n")
    ordered = F.array_sort(F.filter("values", lambda v: v.isNotNull()))
    ranked = one.withColumn("_v", ordered).select(
        *SERIES, "n", "mean", "variance", _sizes("values").alias("ess"),
        F.get("_v", F.floor(half * n).cast("int")).alias("ci_low"), F.get("_v", (F.floor(n - half * n) - 1).cast("int")).alias("ci_high"),
    )
    if many is not None:
        moments = block_moments(many)
        found = moments.join(_long_sizes(many, moments, short), SERIES).join(credible_interval(_points(many, short), c), SERIES)
        ranked = ranked.unionByName(found.select(*ranked.columns))
    return ranked.select(
        *SERIES, "n", "mean", F.sqrt("variance").alias("sd"), F.sqrt(F.col("variance") / F.col("ess")).alias("se"),
        "ess", "ci_low", "ci_high", "variance",
    )


def pair_overlaps(intervals: DataFrame) -> DataFrame:
    """Overlap percentage of the intervals of every two runs of a parameter.

    One row per series enters; the number of pairs is that of the runs compared.
    """
    a = intervals.select("param", F.col("run").alias("run_a"), F.col("ci_low").alias("lo_a"), F.col("ci_high").alias("hi_a"))
    b = intervals.select("param", F.col("run").alias("run_b"), F.col("ci_low").alias("lo_b"), F.col("ci_high").alias("hi_b"))
    inner = F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b")
    outer = F.greatest("hi_a", "hi_b") - F.least("lo_a", "lo_b")
    overlap = F.when(inner < 0, 0.0).when(outer == 0, 100.0).otherwise(100 * inner / outer)
    return a.join(b, "param").filter(F.col("run_a") < F.col("run_b")).select("param", "run_a", "run_b", overlap.alias("overlap"))


def overlap_histogram(overlaps: DataFrame) -> DataFrame:
    """Counts of pair overlaps in 20 bins; bin j holds (5j, 5(j+1)] and bin 0 also zero."""
    bins = F.greatest(F.ceil(F.col("overlap") / 5) - 1, F.lit(0)).cast("int")
    return overlaps.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def compare_runs_traces(report: DataFrame) -> DataFrame:
    """Per parameter: rel_diff (largest difference of means over mean sd), mean ESS, largest CI overlap."""
    sd = F.when(F.col("variance") > 1e-12, F.col("sd")).otherwise(0.0)
    stats = report.groupBy("param").agg(
        F.count(F.lit(1)).alias("n_runs"),
        (F.max("mean") - F.min("mean")).alias("_diff"),
        F.avg(sd).alias("_sd"),
        F.avg("ess").alias("mean_ess"),
    )
    best = pair_overlaps(report).groupBy("param").agg(F.max("overlap").alias("max_overlap"))
    return stats.join(best, "param", "left").select(
        "param", "n_runs",
        F.when(F.col("_sd") > 1e-12, F.col("_diff") / F.col("_sd")).otherwise(0.0).alias("rel_diff"),
        "mean_ess",
        F.coalesce("max_overlap", F.lit(0.0)).alias("max_overlap"),
    )


def overall_convergence(comparison: DataFrame) -> DataFrame:
    """Largest rel_diff, smallest mean ESS and smallest of the largest overlaps."""
    return comparison.agg(
        F.max("rel_diff").alias("max_rel_diff"),
        F.min("mean_ess").alias("min_ess"),
        F.min("max_overlap").alias("min_overlap"),
    )


def running_moments(trace: DataFrame) -> DataFrame:
    """Aggregates that also serve on a growing trace: n, mean, variance."""
    return trace.groupBy(*SERIES).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance")
    )


def unpivot_trace(wide: DataFrame, params: list[str]) -> DataFrame:
    """Wide (run, iter, one column per parameter) to the long form."""
    return wide.unpivot(["run", "iter"], params, "param", "value").withColumn("value", F.col("value").cast("double"))

