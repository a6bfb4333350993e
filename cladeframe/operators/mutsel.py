"""Mutation-selection summaries: selection coefficients, dN/dS, stationary codons.

All quantities depend on a site only through its component, so fluxes are computed
per (draw, component) and spread to the sites by their allocation at the end.

Tables: ``nuc_stat(run, iter, nuc, freq)``, ``nuc_rr(run, iter, n1, n2, value)`` with
n1 < n2, ``codon_profile(run, iter, codon, freq)``, ``aa_profile(run, iter, comp, aa,
freq)``, ``alloc(run, iter, site, comp)``, ``omega(run, iter, omega)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DRAW = ["run", "iter"]

# The histogram of scaled selection coefficients.
BIN_LOW, BIN_HIGH, BIN_STEP = -30.0, 30.0, 0.25
N_BINS = 241
TINY = 1e-20
FLUXES = ["mut", "sub", "nonsyn_mut", "nonsyn_sub", "syn_mut", "syn_sub"]


def fixation_factor(s: Column) -> Column:
    """S / (1 - exp(-S)), and 1 / (1 - S / 2) for a vanishing S; expm1 keeps small S exact."""
    return F.when(F.abs(s) < TINY, 1 / (1 - s / 2)).otherwise(F.try_divide(s, -F.expm1(-s)))


def selection_bin(s: Column) -> Column:
    """Bin number of a coefficient; bin c is centred at -30 + c / 4."""
    inside = F.greatest(F.lit(1), F.ceil((s - BIN_LOW) / BIN_STEP - 0.5).cast("int"))
    return F.when(s < BIN_LOW, 0).when(s > BIN_HIGH, N_BINS - 1).otherwise(inside)


def _as_map(df: DataFrame, keys: list[str], item: Column, value: str, name: str) -> DataFrame:
    """Fold a fixed set of items (bases, codons, acids) of every key into one map."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(item, F.col(value)))).alias(name))


def _codon_rows(codes: DataFrame, nuc_stat: DataFrame, codon_profile: DataFrame, aa_profile: DataFrame) -> DataFrame:
    """One row per (draw, comp, sense codon): its frequency terms and stationary probability."""
    sense = F.broadcast(codes.filter(~F.col("is_stop")).select("codon", "p1", "p2", "p3", "aa"))  # 64 codons at most
    bases = _as_map(nuc_stat, DRAW, F.col("nuc"), "freq", "_nuc")  # four bases
    nuc = F.col("_nuc")
    own = codon_profile.join(sense, "codon").join(bases, DRAW).select(
        *DRAW, "codon", "aa", "_nuc", F.col("freq").alias("cod"),
        (F.col("freq") * nuc[F.col("p1")] * nuc[F.col("p2")] * nuc[F.col("p3")]).alias("_w"),
    )
    acids = aa_profile.select(*DRAW, "comp", "aa", F.col("freq").alias("acid"))
    z = F.col("_w") * F.col("acid")
    total = F.sum(z).over(Window.partitionBy(*DRAW, "comp"))
    return own.join(acids, [*DRAW, "aa"]).select(*DRAW, "comp", "codon", "cod", "acid", "_nuc", (z / total).alias("prob"))


def codon_stationary(codes: DataFrame, nuc_stat: DataFrame, codon_profile: DataFrame, aa_profile: DataFrame) -> DataFrame:
    """Stationary codon probabilities per (draw, comp): product of base, codon and acid terms, normalised."""
    return _codon_rows(codes, nuc_stat, codon_profile, aa_profile).select(*DRAW, "comp", "codon", "prob")


def codon_fluxes(
    codes: DataFrame, neighbours: DataFrame, nuc_stat: DataFrame, nuc_rr: DataFrame,
    codon_profile: DataFrame, aa_profile: DataFrame, omega: DataFrame,
) -> DataFrame:
    """Per (draw, comp, ordered codon pair): S, mutation flux and substitution flux.

    The codons of a component are rows; ``neighbours`` (at most 526 rows) is broadcast
    to the codon a pair starts from, the codon it leads to is an equi-join.
    """
    rows = _codon_rows(codes, nuc_stat, codon_profile, aa_profile)
    rates = _as_map(nuc_rr, DRAW, F.concat("n1", "n2"), "value", "_rr")
    start = rows.select(*DRAW, "comp", F.col("codon").alias("codon_from"), F.col("cod").alias("_c1"), F.col("acid").alias("_a1"), "_nuc", "prob")
    end = rows.select(*DRAW, "comp", F.col("codon").alias("codon_to"), F.col("cod").alias("_c2"), F.col("acid").alias("_a2"))
    steps = (
        start.join(F.broadcast(neighbours.select("codon_from", "codon_to", "nuc_from", "nuc_to", "synonymous")), "codon_from")
        .join(end, [*DRAW, "comp", "codon_to"]).join(rates, DRAW).join(omega, DRAW)
    )
    swap = F.concat(F.least("nuc_from", "nuc_to"), F.greatest("nuc_from", "nuc_to"))
    mut = F.col("_rr")[swap] * F.col("_nuc")[F.col("nuc_to")] * F.col("prob")
    s = F.log(F.col("_c2") / F.col("_c1")) + F.when(F.col("synonymous"), 0.0).otherwise(F.log(F.col("_a2") / F.col("_a1")))
    pull = F.when(F.col("synonymous"), 1.0).otherwise(F.col("omega"))
    flux = steps.select(*DRAW, "comp", "codon_from", "codon_to", "synonymous", "omega", s.alias("s"), mut.alias("mut"))
    return flux.withColumn("sub", F.col("mut") * fixation_factor(F.col("s")) * pull).drop("omega")


def _flux_columns() -> list[Column]:
    syn = F.col("synonymous")
    return [
        F.sum("mut").alias("mut"), F.sum("sub").alias("sub"),
        F.sum(F.when(~syn, F.col("mut")).otherwise(0.0)).alias("nonsyn_mut"),
        F.sum(F.when(~syn, F.col("sub")).otherwise(0.0)).alias("nonsyn_sub"),
        F.sum(F.when(syn, F.col("mut")).otherwise(0.0)).alias("syn_mut"),
        F.sum(F.when(syn, F.col("sub")).otherwise(0.0)).alias("syn_sub"),
    ]


def component_histograms(fluxes: DataFrame) -> DataFrame:
    """Flux per (draw, comp, bin), all / nonsynonymous / synonymous, by mutation and by substitution."""
    return fluxes.groupBy(*DRAW, "comp", selection_bin(F.col("s")).alias("bin")).agg(*_flux_columns())


def _normalised(hist: DataFrame, keys: list[str]) -> DataFrame:
    totals = hist.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in FLUXES])
    return hist.join(totals, keys).select(
        *hist.columns[: len(hist.columns) - len(FLUXES)],
        *[F.when(F.col(f"_t_{c}") > 0, F.col(c) / F.col(f"_t_{c}")).alias(c) for c in FLUXES],
    )


def selection_histograms(fluxes: DataFrame, alloc: DataFrame) -> DataFrame:
    """Histogram over all sites: normalised per draw, then averaged over draws.

    ``centre`` is the middle of the bin. Empty bins are left out.
    """
    n_draws = alloc.select(*DRAW).distinct().agg(F.count(F.lit(1))).scalar()
    sizes = alloc.groupBy(*DRAW, "comp").agg(F.count(F.lit(1)).alias("_n"))
    hist = component_histograms(fluxes).join(sizes, [*DRAW, "comp"])
    pooled = hist.groupBy(*DRAW, "bin").agg(*[F.sum(F.col(c) * F.col("_n")).alias(c) for c in FLUXES])
    return _normalised(pooled, DRAW).groupBy("bin").agg(*[(F.sum(c) / F.first(n_draws)).alias(c) for c in FLUXES]).withColumn(
        "centre", BIN_LOW + F.col("bin") * BIN_STEP
    )


def site_selection_histograms(fluxes: DataFrame, alloc: DataFrame) -> DataFrame:
    """The same per site: each draw's histogram of the site's component, averaged over draws."""
    hist = _normalised(component_histograms(fluxes), [*DRAW, "comp"])
    draws = alloc.groupBy("site").agg(F.count(F.lit(1)).alias("_n"))
    return (
        alloc.join(hist, [*DRAW, "comp"]).groupBy("site", "bin").agg(*[F.sum(c).alias(c) for c in FLUXES])
        .join(draws, "site").select("site", "bin", *[(F.col(c) / F.col("_n")).alias(c) for c in FLUXES])
    )


def site_dnds(fluxes: DataFrame, alloc: DataFrame) -> DataFrame:
    """Mean dN/dS of every site over draws and the share of draws with dN/dS above 1."""
    totals = fluxes.groupBy(*DRAW, "comp").agg(*_flux_columns())
    ratio = F.try_divide(F.col("nonsyn_sub") * F.col("syn_mut"), F.col("syn_sub") * F.col("nonsyn_mut"))
    return alloc.join(totals.withColumn("dnds", ratio), [*DRAW, "comp"]).groupBy("site").agg(
        F.avg("dnds").alias("dnds"), F.avg(F.when(F.col("dnds") > 1, 1.0).otherwise(0.0)).alias("p_above_one")
    )


def mutsel_means(codon_profile: DataFrame, nuc_stat: DataFrame, lengths: DataFrame) -> DataFrame:
    """Posterior means (kind, item, mean, sd): codon profile, base frequencies and tree length."""
    spread = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")]
    parts = [
        (codon_profile, "codon", F.col("codon"), "freq"),
        (nuc_stat, "nuc", F.col("nuc"), "freq"),
        (lengths, "length", F.lit("tree"), "tree_length"),
    ]
    tables = [
        df.select(F.lit(kind).alias("kind"), item.alias("item"), F.col(value).alias("value")).groupBy("kind", "item").agg(*spread)
        for df, kind, item, value in parts
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])
