"""Sufficient statistics of substitution mappings.

``paths(run, iter, branch, site, seq_no, state, rel_time)`` holds the successive
states of every branch and site with the share of the branch each one lasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.ordered import next_in_group

DRAW = ["run", "iter"]
PATH = ["run", "iter", "branch", "site"]


def path_steps(paths: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Every path row with the state that follows it (null at the end of the branch).

    ``bucket`` cuts long paths into order-preserving pieces, by default 1024 rows of ``seq_no``.
    """
    cut = F.floor(F.col("seq_no") / 1024) if bucket is None else bucket
    return next_in_group(paths, PATH, ["seq_no"], cut, {"next_state": "state"})


def substitution_counts(paths: DataFrame) -> DataFrame:
    """Substitutions per (run, iter, branch, site): rows of the path minus one, from one aggregation."""
    return paths.groupBy(*PATH).agg((F.count(F.lit(1)) - 1).alias("n_sub"))


def branch_suffstats(counts: DataFrame, rates: DataFrame, informative: DataFrame | None = None) -> DataFrame:
    """Per branch: substitutions and exposure, the sum of the site rates.

    ``counts`` comes from :func:`substitution_counts`; ``rates(site, rate)``;
    ``informative(branch, site)`` restricts to informative branches.
    """
    if informative is not None:
        counts = counts.join(informative.select("branch", "site"), ["branch", "site"], "left_semi")
    return counts.join(rates, "site").groupBy(*DRAW, "branch").agg(
        F.sum("n_sub").alias("n_sub"), F.sum("rate").alias("exposure")
    )


def site_rate_suffstats(counts: DataFrame, lengths: DataFrame, informative: DataFrame | None = None) -> DataFrame:
    """Per site: substitutions and the sum of branch lengths."""
    if informative is not None:
        counts = counts.join(informative.select("branch", "site"), ["branch", "site"], "left_semi")
    return counts.join(lengths, "branch").groupBy(*DRAW, "site").agg(
        F.sum("n_sub").alias("n_sub"), F.sum("length").alias("exposure")
    )


def site_profile_suffstats(steps: DataFrame, root: DataFrame) -> DataFrame:
    """State counts per site: the root state once, then every state a substitution leads to.

    ``root(run, iter, site, state)``.
    """
    entered = steps.filter(F.col("next_state").isNotNull()).select(*DRAW, "site", F.col("next_state").alias("state"))
    return root.select(*DRAW, "site", "state").unionByName(entered).groupBy(*DRAW, "site", "state").agg(F.count(F.lit(1)).alias("n"))


def mean_site_profile_suffstats(counts: DataFrame, n_draws: int | Column) -> DataFrame:
    """Average counts over draws; a draw without the state counts as zero."""
    return counts.groupBy("site", "state").agg((F.sum("n") / F.lit(n_draws)).alias("mean_n"))


def path_suffstats(steps: DataFrame, factors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pair counts (site, from, to, n) and waiting times (site, state, time).

    ``factors(branch, site, factor)`` is rate times branch length, 1 when left out.
    """
    pairs = (
        steps.filter(F.col("next_state").isNotNull())
        .groupBy(*DRAW, "site", F.col("state").alias("s_from"), F.col("next_state").alias("s_to"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    timed = steps.withColumn("factor", F.lit(1.0)) if factors is None else steps.join(factors, ["branch", "site"])
    waits = timed.groupBy(*DRAW, "site", "state").agg(F.sum(F.col("rel_time") * F.col("factor")).alias("time"))
    return pairs, waits


def path_suffstat_maps(pairs: DataFrame) -> DataFrame:
    """Pair counts of every site as one map from 'from>to' to count."""
    entry = F.struct(F.concat_ws(">", "s_from", "s_to"), "n")
    return pairs.groupBy(*DRAW, "site").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("pair_counts"))


def path_rate_suffstats(steps: DataFrame, diagonal: DataFrame, factor: float = 1.0) -> DataFrame:
    """Per site: substitutions and minus the sum of rel_time * factor * q(s, s); ``diagonal(state, q)``."""
    return steps.join(diagonal, "state").groupBy(*DRAW, "site").agg(
        F.count("next_state").alias("n_sub"), (-F.sum(F.col("rel_time") * F.lit(factor) * F.col("q"))).alias("beta")
    )


def rr_suffstats(pairs: DataFrame, waits: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per unordered state pair: substitutions between them and exposure.

    The exposure of (a, b) is time in a times the profile of b plus the reverse;
    ``profiles(site, state, freq)``.
    """
    ordered = pairs.select(
        *DRAW, F.least("s_from", "s_to").alias("s1"), F.greatest("s_from", "s_to").alias("s2"), "n"
    ).filter(F.col("s1") != F.col("s2"))
    counts = ordered.groupBy(*DRAW, "s1", "s2").agg(F.sum("n").alias("n"))
    target = profiles.select("site", F.col("state").alias("other"), "freq")
    exposure = (
        waits.join(target, "site").filter(F.col("state") != F.col("other"))
        .groupBy(*DRAW, F.least("state", "other").alias("s1"), F.greatest("state", "other").alias("s2"))
        .agg(F.sum(F.col("time") * F.col("freq")).alias("beta"))
    )
    return exposure.join(counts, [*DRAW, "s1", "s2"], "left").fillna(0, ["n"])


def component_suffstats(site_counts: DataFrame, alloc: DataFrame) -> DataFrame:
    """Site counts summed over the sites of each component."""
    return site_counts.join(alloc, [*DRAW, "site"]).groupBy(*DRAW, "comp", "state").agg(F.sum("n").alias("n"))


def rate_category_suffstats(site_stats: DataFrame, rate_alloc: DataFrame) -> DataFrame:
    """Substitutions and exposure summed over the sites of each rate category; (site, cat)."""
    return site_stats.join(rate_alloc, "site").groupBy(*DRAW, "cat").agg(
        F.sum("n_sub").alias("n_sub"), F.sum("exposure").alias("exposure")
    )


def mapping_diff(obs: DataFrame, pred: DataFrame) -> DataFrame:
    """Substitutions per site of observed and predicted mappings: means, difference and its population sd.

    Both inputs are (draw, per_site).
    """
    both = obs.select("draw", F.col("per_site").alias("o")).join(pred.select("draw", F.col("per_site").alias("p")), "draw")
    diff = F.col("o") - F.col("p")
    return both.agg(
        F.avg("o").alias("mean_obs"), F.avg("p").alias("mean_pred"), F.avg(diff).alias("mean_diff"), F.stddev_pop(diff).alias("sd_diff")
    )


def nonsyn_counts(pairs: DataFrame, translation: DataFrame | None) -> DataFrame:
    """Nonsynonymous substitutions per draw; without a translation (state, aa) all pairs count."""
    if translation is None:
        return pairs.groupBy("draw").agg(F.sum("n").alias("n"))
    a = translation.select(F.col("state").alias("s_from"), F.col("aa").alias("aa_from"))
    b = translation.select(F.col("state").alias("s_to"), F.col("aa").alias("aa_to"))
    return (
        pairs.join(F.broadcast(a), "s_from").join(F.broadcast(b), "s_to")
        .groupBy("draw").agg(F.sum(F.when(F.col("aa_from") != F.col("aa_to"), F.col("n")).otherwise(0)).alias("n"))
    )


def nonsyn_test(obs: DataFrame, pred: DataFrame) -> DataFrame:
    """Per draw both counts, and P(pred > obs) over draws."""
    both = obs.select("draw", F.col("n").alias("n_obs")).join(pred.select("draw", F.col("n").alias("n_pred")), "draw")
    return both.agg(
        F.count(F.lit(1)).alias("n_draws"), F.avg("n_obs").alias("mean_obs"), F.avg("n_pred").alias("mean_pred"),
        F.avg(F.when(F.col("n_pred") > F.col("n_obs"), 1.0).otherwise(0.0)).alias("pvalue"),
    )
