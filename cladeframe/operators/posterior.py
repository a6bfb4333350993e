"""Posterior summaries of chain draws: profiles, allocations, exchangeabilities, predictive tests.

Tables: ``draws(run, iter, ...)``, ``profiles(run, iter, comp, state, freq)``,
``weights(run, iter, comp, w)``, ``alloc(run, iter, site, comp)``,
``rr(run, iter, s1, s2, value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.trace import credible_interval, trace_ci
from cladeframe.session import durable

DRAW = ["run", "iter"]
#: States of a profile that become columns: one bit of a long each.
STATES_AT_ONCE = 62


def posterior_summary(draws: DataFrame, params: list[str], tail: float | None = None) -> DataFrame:
    """Mean and interval of scalar parameters; ``tail`` = 0.05 takes positions n tail and n (1 - tail)."""
    long = draws.unpivot(DRAW, params, "param", "value").withColumn("value", F.col("value").cast("double"))
    if tail is not None:
        return trace_ci(long, tail, ["param"])
    means = long.groupBy("param").agg(F.avg("value").alias("mean"))
    return means.join(credible_interval(long, 0.95, ["param"]), "param")


def site_profiles(alloc: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile of every site in every draw."""
    return alloc.join(profiles, [*DRAW, "comp"])


def mean_site_profiles(alloc: DataFrame, profiles: DataFrame) -> DataFrame:
    """Posterior mean profile per site, averaged over all draws.

    A state missing from a component's profile counts as zero there. Profiles become one
    row per component with a column per state, so that a task sums one row per site; with
    more than ``STATES_AT_ONCE`` states it sums a row per site and state.
    """
    profiles = durable(profiles.select(*DRAW, "comp", "state", "freq"))
    states = [r.state for r in profiles.select("state").distinct().limit(STATES_AT_ONCE + 1).collect()]
    if not 0 < len(states) <= STATES_AT_ONCE:
        seen = alloc.groupBy("site").agg(F.count(F.lit(1)).alias("_n"))
        sums = site_profiles(alloc, profiles).groupBy("site", "state").agg(F.sum("freq").alias("_s"))
        return sums.join(seen, "site").select("site", "state", (F.col("_s") / F.col("_n")).alias("freq"))
    kind = profiles.schema["state"].dataType
    names = [F.lit(s).cast(kind) for s in states]
    sums = [f"_s{i}" for i in range(len(states))]
    own = [F.col("state").eqNullSafe(s) for s in names]
    marks = [F.when(o, F.lit(1 << i).cast("bigint")) for i, o in enumerate(own)]  # which states there are
    wide = profiles.groupBy(*DRAW, "comp").agg(
        *[F.sum(F.when(o, F.col("freq"))).alias(c) for o, c in zip(own, sums, strict=True)],
        F.bit_or(F.coalesce(*marks, F.lit(0).cast("bigint"))).alias("_has"),
    )
    by_site = alloc.join(wide, [*DRAW, "comp"], "left").filter(F.col("site").isNotNull()).groupBy("site").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_or("_has").alias("_has"), *[F.sum(c).alias(c) for c in sums]
    )
    listed = F.array(*[
        F.struct(s.alias("state"), F.col(c).alias("sum"), (F.col("_has").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0).alias("has"))
        for i, (s, c) in enumerate(zip(names, sums, strict=True))
    ])
    rows = by_site.select("site", "_n", F.explode(listed).alias("_p"))
    return rows.filter("_p.has").select("site", "_p.state", (F.col("_p.sum") / F.col("_n")).alias("freq"))


def normalised_exchangeabilities(rr: DataFrame) -> DataFrame:
    """Exchangeabilities of each draw divided by their mean over the pairs."""
    centre = rr.groupBy(*DRAW).agg(F.avg("value").alias("_m"))
    return rr.join(centre, DRAW).withColumn("value", F.col("value") / F.col("_m")).drop("_m")


def mean_exchangeabilities(rr: DataFrame) -> DataFrame:
    return normalised_exchangeabilities(rr).groupBy("s1", "s2").agg(F.avg("value").alias("value"))


def cluster_counts(alloc: DataFrame) -> DataFrame:
    """Per draw: occupied components and effective number 1 / sum of squared shares."""
    sizes = alloc.groupBy(*DRAW, "comp").agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    return sizes.groupBy(*DRAW).agg(
        F.count(F.lit(1)).alias("n_occupied"), (n * n / F.sum(F.col("_n") * F.col("_n"))).alias("n_effective")
    )


def cluster_summary(counts: DataFrame) -> DataFrame:
    """Mean and population sd over draws, per run."""
    return counts.groupBy("run").agg(
        F.avg("n_occupied").alias("mean_occupied"), F.stddev_pop("n_occupied").alias("sd_occupied"),
        F.avg("n_effective").alias("mean_effective"), F.stddev_pop("n_effective").alias("sd_effective"),
    )


def _plogp(p: Column) -> Column:
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)


def profile_entropy(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy(*DRAW, "comp").agg(F.sum(_plogp(F.col("freq"))).alias("entropy"))


def mean_profile_entropy(profiles: DataFrame, alloc: DataFrame) -> DataFrame:
    """Entropy of the components weighted by their numbers of sites, per draw."""
    sizes = alloc.groupBy(*DRAW, "comp").agg(F.count(F.lit(1)).alias("_n"))
    return profile_entropy(profiles).join(sizes, [*DRAW, "comp"]).groupBy(*DRAW).agg(
        (F.sum(F.col("entropy") * F.col("_n")) / F.sum("_n")).alias("mean_entropy")
    )


def center_entropy(dirweight: DataFrame) -> DataFrame:
    """Entropy of the normalised centre weights (run, iter, state, value)."""
    totals = dirweight.groupBy(*DRAW).agg(F.sum("value").alias("_t"))
    return dirweight.join(totals, DRAW).groupBy(*DRAW).agg(F.sum(_plogp(F.col("value") / F.col("_t"))).alias("entropy"))


def rr_entropy(rr: DataFrame) -> DataFrame:
    """Entropy of the exchangeability shares above 1e-6, and squared coefficient of variation."""
    totals = rr.groupBy(*DRAW).agg(F.sum("value").alias("_t"))
    share = F.col("value") / F.col("_t")
    return rr.join(totals, DRAW).groupBy(*DRAW).agg(
        F.sum(F.when(share > 1e-6, -share * F.log(share)).otherwise(0.0)).alias("entropy"),
        (F.var_pop("value") / F.pow(F.avg("value"), 2)).alias("var_coeff"),
    )


def posterior_hyper(values: DataFrame, keys: list[str]) -> DataFrame:
    """Gamma fitted by moments per parameter: shape mean^2 / var, rate mean / var (population var)."""
    m, v = F.avg("value"), F.var_pop("value")
    return values.groupBy(*keys).agg(F.try_divide(m * m, v).alias("shape"), F.try_divide(m, v).alias("rate"))


def dirichlet_concentration(profile: DataFrame) -> DataFrame:
    """Dirichlet weights of a single profile (state, value): (sum m(1-m) / sum v - 1) m."""
    per_state = profile.groupBy("state").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    conc = per_state.agg((F.sum(F.col("m") * (1 - F.col("m"))) / F.sum("v") - 1).alias("c")).scalar()
    return per_state.select("state", (conc * F.col("m")).alias("weight"))


def ppred_test(obs: DataFrame, reps: DataFrame) -> DataFrame:
    """Posterior predictive test of one-row-per-statistic tables.

    ``obs(stat, value)``, ``reps(stat, rep, value)``. The diversity statistic is tested
    downwards: z = (mean - obs) / sd and p = P(stat < obs); the others upwards.
    """
    joined = reps.join(obs.select("stat", F.col("value").alias("obs")), "stat")
    down = F.col("stat") == "mean_diversity"
    sums = joined.groupBy("stat", "obs").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.avg(F.when(F.col("value") > F.col("obs"), 1.0).otherwise(0.0)).alias("_above"),
        F.avg(F.when(F.col("value") < F.col("obs"), 1.0).otherwise(0.0)).alias("_below"),
        F.count(F.when(F.col("value") == F.col("obs"), 1)).alias("ties"),
    )
    gap = F.when(down, F.col("mean") - F.col("obs")).otherwise(F.col("obs") - F.col("mean"))
    return sums.select(
        "stat", "obs", "mean", "sd", F.when(F.col("sd") > 0, gap / F.col("sd")).alias("z"),
        F.when(down, F.col("_below")).otherwise(F.col("_above")).alias("p"), "ties",
    )


def ppred_taxa(obs: DataFrame, reps: DataFrame) -> DataFrame:
    """Per taxon: observed distance, predicted mean, z and P(pred > obs)."""
    joined = reps.select("taxon", F.col("dist").alias("_d")).join(obs.select("taxon", F.col("dist").alias("obs")), "taxon")
    sums = joined.groupBy("taxon", "obs").agg(
        F.avg("_d").alias("mean"), F.stddev_pop("_d").alias("_sd"), F.avg(F.when(F.col("_d") > F.col("obs"), 1.0).otherwise(0.0)).alias("pp")
    )
    return sums.select("taxon", "obs", "mean", F.when(F.col("_sd") > 0, (F.col("obs") - F.col("mean")) / F.col("_sd")).alias("z"), "pp")
