"""Composition and diversity statistics of alignments.

Everything starts from :func:`state_counts`: one aggregation gives the counts of
all states per site or per taxon, and the statistics are array expressions on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.moments import shares, squared_distance, total
from cladeframe.operators.alignment import observed, site_grid, state_counts


def empirical_freq(cells: DataFrame, states: list[str], pseudocount_denominator: bool = False) -> DataFrame:
    """Frequency of every state over all observed cells.

    ``pseudocount_denominator`` starts the denominator at the number of states.
    """
    counts = observed(cells).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    extra = len(states) if pseudocount_denominator else 0
    # at most one row per state from here on
    everything = Window.partitionBy(F.lit(1))
    return counts.select("state", "n", (F.col("n") / (F.sum("n").over(everything) + extra)).alias("freq"))


def site_freq(cells: DataFrame) -> DataFrame:
    """Frequency of every observed state at every site."""
    w = Window.partitionBy("site")
    counts = observed(cells).groupBy("site", "state").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("site", "state", (F.col("n") / F.sum("n").over(w)).alias("freq"))


def _site_shares(cells: DataFrame, states: list[str], keys: list[str]) -> DataFrame:
    counts = state_counts(observed(cells), [*keys, "site"], states)
    return counts.withColumn("f", shares(F.col("counts")))


def _distinct(counts: Column) -> Column:
    return F.size(F.filter(counts, lambda c: c > 0))


def mean_freq_variance_columns(n_states: int) -> Column:
    """Mean over states of the population variance of the site frequencies."""
    parts = [F.var_pop(F.col("f")[k]) for k in range(n_states)]
    return sum(parts[1:], parts[0]) / F.lit(n_states)


def site_statistics(cells: DataFrame, states: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean diversity, mean squared frequency and mean frequency variance in one pass."""
    keys = keys or []
    per_site = _site_shares(cells, states, keys)
    square = total(F.transform(F.col("f"), lambda f: f * f))
    stats = [
        F.avg(_distinct(F.col("counts"))).alias("mean_diversity"),
        F.avg(square).alias("mean_squared_freq"),
        mean_freq_variance_columns(len(states)).alias("mean_freq_variance"),
    ]
    return per_site.groupBy(*keys).agg(*stats) if keys else per_site.agg(*stats)


def mean_diversity(cells: DataFrame, states: list[str]) -> DataFrame:
    return site_statistics(cells, states).select("mean_diversity")


def mean_squared_freq(cells: DataFrame, states: list[str]) -> DataFrame:
    return site_statistics(cells, states).select("mean_squared_freq")


def mean_freq_variance(cells: DataFrame, states: list[str]) -> DataFrame:
    return site_statistics(cells, states).select("mean_freq_variance")


def distances_from_counts(counts: DataFrame, n_states: int, pooled: bool, keys: list[str]) -> DataFrame:
    """Squared distance of every taxon's composition from the global one.

    ``counts`` has one row per (keys, taxon). The global composition is the plain
    mean over taxa, or the pooled counts.
    """
    freqs = counts.withColumn("f", shares(F.col("counts"))).filter(F.col("f").isNotNull())
    part = [F.avg(F.col("f")[k]) if not pooled else F.sum(F.col("counts")[k]) for k in range(n_states)]
    centre = freqs.groupBy(*keys).agg(*[p.alias(f"_g{k}") for k, p in enumerate(part)])
    g = F.array(*[f"_g{k}" for k in range(n_states)])
    centre = centre.select(*keys, (shares(g) if pooled else g).alias("g"))
    if keys:
        joined = freqs.join(centre, keys)
        return joined.withColumn("dist", squared_distance(F.col("f"), F.col("g")))
    return freqs.withColumn("g", centre.select("g").scalar()).withColumn("dist", squared_distance(F.col("f"), F.col("g")))


def composition_heterogeneity(
    cells: DataFrame, states: list[str], keys: list[str] | None = None, pooled: bool = False
) -> DataFrame:
    """Per taxon: squared distance of its composition from the global composition."""
    keys = keys or []
    counts = state_counts(observed(cells), [*keys, "taxon"], states)
    return distances_from_counts(counts, len(states), pooled, keys).select(*keys, "taxon", "dist")


def heterogeneity_summary(distances: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Largest and mean distance over taxa."""
    stats = [F.max("dist").alias("max_dist"), F.avg("dist").alias("mean_dist")]
    return distances.groupBy(*keys).agg(*stats) if keys else distances.agg(*stats)


def site_orbits(cells: DataFrame, states: list[str]) -> DataFrame:
    """Observed states of each site in alphabet order, with orbit and zip size."""
    counts = state_counts(observed(cells), ["site"], states)
    names = F.array(*[F.lit(s) for s in states])
    orbit = F.filter(F.zip_with(names, F.col("counts"), lambda s, c: F.when(c > 0, s)), lambda s: s.isNotNull())
    return counts.select(
        "site",
        orbit.alias("orbit"),
        F.size(orbit).alias("orbit_size"),
        F.least(F.size(orbit) + 1, F.lit(len(states))).alias("zip_size"),
    )


def zip_cells(cells: DataFrame, orbits: DataFrame) -> DataFrame:
    """Local code of every observed cell: its place in the orbit of the site, null if missing."""
    return cells.join(orbits.select("site", "orbit"), "site", "left").select(
        "taxon",
        "site",
        "state",
        F.when(F.col("state").isNotNull(), F.array_position("orbit", F.col("state")) - 1).cast("int").alias("code"),
    )


def orbit_summary(orbits: DataFrame, n_states: int, n_sites: int | None = None) -> DataFrame:
    """Mean orbit size, mean (zip size / K)^2 and number of sites with a single state."""
    if n_sites is not None:
        orbits = site_grid(orbits, n_sites).join(orbits, "site", "left").fillna(0, ["orbit_size"]).fillna(1, ["zip_size"])
    zipped = F.col("zip_size") / F.lit(n_states)
    return orbits.agg(
        F.avg("orbit_size").alias("mean_orbit"),
        F.avg(zipped * zipped).alias("speed_factor"),
        F.count(F.when(F.col("orbit_size") == 1, 1)).alias("n_constant"),
    )
