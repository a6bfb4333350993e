"""Model-fit scores from per-site log-likelihoods and stepping increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.logspace import log_moments
from cladeframe.functions.ordered import prefix_sum
from cladeframe.functions.student import t95


def cv_score(site_logl: DataFrame) -> DataFrame:
    """Joint cross-validation score per run: log mean over draws of exp(total log-likelihood)."""
    draws = site_logl.groupBy("run", "iter").agg(F.sum("logl").alias("score"))
    return log_moments(draws, ["run"], "score").select(
        "run", F.col("n").alias("n_draws"), F.col("log_mean_exp").alias("cv"), "ess",
        F.col("mean").alias("mean_score"), F.col("var").alias("var_score"),
    )


def site_cv(site_logl: DataFrame) -> DataFrame:
    """Per (run, site) log mean exp over draws with its importance ESS."""
    return log_moments(site_logl, ["run", "site"], "logl").select(
        "run", "site", F.col("log_mean_exp").alias("cv"), "ess"
    )


def site_cv_summary(scores: DataFrame, min_ess: float = 10.0) -> DataFrame:
    """Per run: mean score, mean ESS, share of sites below ``min_ess``, total score."""
    return scores.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.avg("cv").alias("mean_cv"),
        F.avg("ess").alias("mean_ess"),
        F.avg(F.when(F.col("ess") < min_ess, 1.0).otherwise(0.0)).alias("frac_low_ess"),
        (F.count(F.lit(1)) * F.avg("cv")).alias("total_cv"),
    )


def site_scores(site_logl: DataFrame) -> DataFrame:
    """Mean, population variance, log CPO and log posterior mean likelihood with their ESS."""
    return log_moments(site_logl, ["run", "site"], "logl").select(
        "run", "site", "n", F.col("mean").alias("logl"), "var",
        F.col("log_harmonic").alias("logcpo"), F.col("ess_harmonic").alias("ess_cpo"),
        F.col("log_mean_exp").alias("logpostmeanl"), F.col("ess").alias("ess_l"),
    )


def run_fit(scores: DataFrame, min_ess: float = 10.0) -> DataFrame:
    """Per run wAIC and leave-one-out score per site."""
    def low(c: str) -> Column:
        return F.avg(F.when(F.col(c) < min_ess, 1.0).otherwise(0.0))

    return scores.groupBy("run").agg(
        (F.avg("logpostmeanl") - F.avg("var")).alias("waic"),
        F.avg("ess_l").alias("waic_ess"),
        low("ess_l").alias("waic_low_ess"),
        F.avg("logcpo").alias("loocv"),
        F.avg("ess_cpo").alias("loocv_ess"),
        low("ess_cpo").alias("loocv_low_ess"),
    )


def loocv_waic(scores: DataFrame, min_ess: float = 10.0, last_run: bool = False) -> DataFrame:
    """Scores over runs: one row for LOO-CV and one for wAIC; one run has no bias, sd and interval (null).

    The bias is half the mean across-run variance of the site terms, plus for LOO-CV
    and minus for wAIC, and is subtracted. The interval uses Student's t with
    n_runs - 1 degrees of freedom. ``last_run`` takes the LOO-CV share of the
    low-ESS sites from the last run only instead of the mean over runs.
    """
    lowest = F.max_by("logcpo", "run") if last_run else F.avg("logcpo")
    sites = scores.groupBy("site").agg(
        F.var_samp("logcpo").alias("v_loo"), F.avg("ess_cpo").alias("e_loo"), lowest.alias("s_loo"),
        F.var_samp("logpostmeanl").alias("v_waic"), F.avg("ess_l").alias("e_waic"),
        F.avg(F.col("logpostmeanl") - F.col("var")).alias("s_waic"),
    )
    site_part = sites.agg(
        F.count(F.lit(1)).alias("n_sites"),
        *[
            expr
            for k in ("loo", "waic")
            for expr in (
                F.avg(f"v_{k}").alias(f"v_{k}"),
                F.avg(f"e_{k}").alias(f"e_{k}"),
                F.count(F.when(F.col(f"e_{k}") < min_ess, 1)).alias(f"low_{k}"),
                F.avg(F.when(F.col(f"e_{k}") < min_ess, F.col(f"s_{k}")).otherwise(0.0)).alias(f"f_{k}"),
            )
        ],
    )
    per_run = scores.groupBy("run").agg(
        F.avg("logcpo").alias("loo"), (F.avg("logpostmeanl") - F.avg("var")).alias("waic")
    )
    run_part = per_run.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("loo").alias("m_loo"), F.stddev_samp("loo").alias("sd_loo"),
        F.avg("waic").alias("m_waic"), F.stddev_samp("waic").alias("sd_waic"),
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    row = one(site_part).join(one(run_part), "_one").withColumn("df", (F.col("n_runs") - 1).cast("int"))
    row = row.withColumn("t95", t95(F.col("df")))

    def line(name: str, key: str, sign: float) -> Column:
        bias = sign * 0.5 * F.col(f"v_{key}")
        centre = F.col(f"m_{key}") - bias
        margin = F.col("t95") * F.col(f"sd_{key}")
        return F.struct(
            F.lit(name).alias("score_name"), centre.alias("score"), bias.alias("bias"),
            F.col(f"sd_{key}").alias("stdev"), (centre - margin).alias("ci_low"), (centre + margin).alias("ci_high"),
            F.col(f"e_{key}").alias("mean_ess"), (F.col(f"low_{key}") / F.col("n_sites")).alias("frac_low_ess"),
            F.abs(F.col(f"f_{key}") / F.col(f"m_{key}")).alias("score_low_ess"),
        )

    return row.select("n_runs", "n_sites", F.explode(F.array(line("loocv", "loo", 1.0), line("waic", "waic", -1.0))).alias("_r")).select(
        "_r.*", "n_runs", "n_sites"
    )


def stepping_estimate(stepping_draws: DataFrame) -> DataFrame:
    """Per (run, cycle): log mean exp(delta), mean, population variance, mean prior delta, n, ESS."""
    prior = stepping_draws.groupBy("run", "cycle").agg(F.avg("dlogprior").alias("meanlogprior"))
    logs = log_moments(stepping_draws, ["run", "cycle"], "delta")
    return logs.join(prior, ["run", "cycle"]).select(
        "run", "cycle", F.col("log_mean_exp").alias("logz"), F.col("mean").alias("meanlogp"),
        "meanlogprior", F.col("var").alias("varlogp"), F.col("n").alias("npoint"), "ess",
    )


def stepping_target(stepping: DataFrame, n_min: float, max_var: float, n_max: float) -> DataFrame:
    """Number of points the next pass needs: n_min exp(var - max_var) above max_var, capped at n_max."""
    grown = F.least(n_min * F.exp(F.col("varlogp") - max_var), F.lit(float(n_max)))
    return stepping.withColumn(
        "target", F.when(F.col("varlogp") > max_var, grown).otherwise(F.lit(float(n_min))).cast("bigint")
    )


def marginal_likelihood(stepping: DataFrame, min_ess: float = 10.0) -> DataFrame:
    """Per-site marginal likelihood over runs, debiased, with a Student interval of n_runs - 1 degrees (null for one run)."""
    cycles = stepping.groupBy("cycle").agg(F.var_samp("logz").alias("v"), F.avg("ess").alias("e"))
    cycle_part = cycles.agg(
        F.count(F.lit(1)).alias("n_sites"), F.avg("v").alias("v"), F.avg("e").alias("mean_ess"),
        F.count(F.when(F.col("e") < min_ess, 1)).alias("n_low_ess"),
    ).withColumn("_one", F.lit(1))
    runs = stepping.groupBy("run").agg(F.avg("logz").alias("z"))
    run_part = runs.agg(F.count(F.lit(1)).alias("n_runs"), F.avg("z").alias("score")).withColumn("_one", F.lit(1))
    row = cycle_part.join(run_part, "_one").withColumn("df", (F.col("n_runs") - 1).cast("int"))
    row = row.withColumn("t95", t95(F.col("df")))
    bias = -0.5 * F.col("v")
    sd = F.sqrt(F.col("v") / F.col("n_sites") / F.col("n_runs"))
    centre = F.col("score") - bias
    return row.select(
        "n_sites", "n_runs", "score", centre.alias("debiased"),
        (centre - F.col("t95") * sd).alias("ci_low"), (centre + F.col("t95") * sd).alias("ci_high"),
        bias.alias("bias"), sd.alias("stdev"), "mean_ess", "n_low_ess",
    )


def curve_sizes(n_sites: int) -> list[tuple[int, int]]:
    """(k, number of subsets) of the cross-validation curve: steps of 1, then 10, then 100."""
    sizes, k, step = [], 1, 1
    while k <= n_sites:
        sizes.append((k, 1000 * n_sites // k))
        step = 100 if k > 100 else 10 if k > 10 else step
        k += step
    return sizes


def cv_subset_curve(site_logl: DataFrame, subsets: DataFrame) -> DataFrame:
    """Cross-validation score against the number of sites, averaged over site subsets.

    ``subsets`` is (k, rep, site). ``var_lognormal`` is (exp(var) - 1) / n.
    """
    keys = ["run", "k", "rep"]
    totals = site_logl.join(subsets, "site").groupBy(*keys, "iter").agg(F.sum("logl").alias("score"))
    logs = log_moments(totals, keys, "score")
    n = F.col("n")
    v = n / F.col("ess") - 1
    return logs.groupBy("run", "k").agg(
        F.count(F.lit(1)).alias("n_subsets"),
        F.avg(F.col("log_mean_exp") / F.col("k")).alias("cv"),
        F.avg(v / 2 / n).alias("bias"),
        F.avg(v / n).alias("var"),
        F.avg((F.exp("var") - 1) / n).alias("var_lognormal"),
        F.avg("mean").alias("mean_logl"),
        F.avg("var").alias("var_logl"),
        F.avg("ess").alias("mean_ess"),
        F.min("ess").alias("min_ess"),
    )


def truncate_mixture(weights: DataFrame, cutoff: float, keys: list[str] | None = None) -> DataFrame:
    """Drop components from the last one while the weight dropped so far is below ``cutoff``."""
    keys = keys or ["run", "iter"]
    order = -F.col("comp")
    placed = prefix_sum(weights, keys, [order], F.floor(order / 4096), F.col("w"), "_d")
    return placed.filter(F.col("_d") >= cutoff).drop("_d")
