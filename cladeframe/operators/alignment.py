"""Row and column operators over ``cells(taxon, site, state)``.

A missing cell may be stored with a null state or left out. Operators that need
the number of missing cells take the extents (``n_taxa``, ``n_sites``) and count
observed cells instead, so a sparse table is never filled up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.ordered import position_in_group, prefix_sum
from cladeframe.session import durable

SITE_BUCKET = 4096


def observed(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("state").isNotNull())


def state_counts(cells: DataFrame, keys: list[str], states: list[str], name: str = "counts") -> DataFrame:
    """Counts of every state per key, as an array in the order of ``states``.

    One hash aggregation with map-side combine; states that do not occur are 0, so
    nothing has to be densified with a join. A state that isn't listed raises.
    """
    other = F.count(F.when(~F.col("state").isin(states), 1)).alias("_other")
    counts = F.array(*[f"_c{i}" for i in range(len(states))])
    wrong = F.raise_error(F.lit("a state is not in the given list")).cast("array<bigint>")
    return cells.groupBy(*keys).agg(*count_columns(F.col("state"), states), other).select(
        *keys, F.when(F.col("_other") == 0, counts).otherwise(wrong).alias(name)
    )


def count_columns(state: Column, states: list[str]) -> list[Column]:
    return [F.count(F.when(state == s, 1)).alias(f"_c{i}") for i, s in enumerate(states)]


def renumber(sites: DataFrame, name: str = "new_site") -> DataFrame:
    """Distinct ``site`` values with dense numbers from 0."""
    # read twice, and often found by a pass over all cells
    named = durable(sites.select("site").distinct())
    return position_in_group(named, [], ["site"], F.floor(F.col("site") / SITE_BUCKET), name)


def encode_states(cells: DataFrame, alphabet: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Replace raw symbols by states; ambiguity letters become null, unknown ones raise.

    The alphabet is a fixed small dimension, so it is broadcast.
    """
    names = F.broadcast(alphabet.select(F.col("symbol").alias("_s"), F.col("state"), F.lit(True).alias("_known")))
    joined = cells.drop("state").join(names, F.col(symbol) == F.col("_s"), "left")
    bad = F.col(symbol).isNotNull() & F.col("_known").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unknown state letter: "), F.col(symbol)))).otherwise(F.col("state"))
    return joined.withColumn("state", checked.cast("string")).drop("_s", "_known", symbol)


def select_sites(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Keep the sites of ``mask`` and renumber them densely from 0."""
    return cells.join(renumber(mask), "site").withColumn("site", F.col("new_site").cast("int")).drop("new_site")


def slice_sites(cells: DataFrame, start: int, length: int, n_sites: int) -> DataFrame:
    """Sites start .. start+length-1, renumbered from 0."""
    if start < 0 or length < 0 or start + length > n_sites:
        raise ValueError(f"slice [{start}, {start + length}) is outside 0..{n_sites}")
    return cells.filter((F.col("site") >= start) & (F.col("site") < start + length)).withColumn(
        "site", F.col("site") - F.lit(start)
    )


def select_taxa(cells: DataFrame, taxa: DataFrame) -> DataFrame:
    return cells.join(taxa.select("taxon").distinct(), "taxon", "left_semi")


def taxon_index(cells: DataFrame) -> DataFrame:
    """Ordered unique taxon names with their index.

    The names are dealt out by ranges that Spark draws from the names themselves, so a
    common beginning does not put them into one task.
    """
    names = cells.select(F.col("taxon").cast("string").alias("taxon")).distinct()
    dealt = durable(names.repartitionByRange("taxon").withColumn("_part", F.spark_partition_id()))
    return position_in_group(dealt, [], ["taxon"], F.col("_part"), "taxon_ix").drop("_part")


def check_unique_taxa(seqs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Raise at run time when a taxon name occurs twice in the wide table."""
    keys = keys or ["taxon"]
    return seqs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("taxon found twice: "), F.col("taxon").cast("string")))).otherwise(F.col("_n"))
    ).drop("_n")


def site_grid(cells: DataFrame, n_sites: int) -> DataFrame:
    """All site numbers of an alignment with ``n_sites`` columns."""
    return cells.sparkSession.range(n_sites).select(F.col("id").cast("int").alias("site"))


def site_summary(cells: DataFrame, n_sites: int | None = None) -> DataFrame:
    """Per site: observed cells, smallest and largest state, from one aggregation."""
    per_site = cells.groupBy("site").agg(
        F.count("state").alias("n_obs"), F.min("state").alias("min_state"), F.max("state").alias("max_state")
    )
    if n_sites is None:
        return per_site
    return (
        site_grid(cells, n_sites)
        .join(per_site, "site", "left")
        .withColumn("n_obs", F.coalesce("n_obs", F.lit(0).cast("bigint")))
    )


def all_missing_sites(cells: DataFrame, n_sites: int | None = None) -> DataFrame:
    return site_summary(cells, n_sites).filter(F.col("n_obs") == 0).select("site")


def complete_sites(cells: DataFrame, n_taxa: Column | int) -> DataFrame:
    """Sites observed in every taxon."""
    total = F.lit(n_taxa) if isinstance(n_taxa, int) else n_taxa
    return site_summary(cells).filter(F.col("n_obs") == total).select("site")


def constant_sites(cells: DataFrame, n_sites: int | None = None) -> DataFrame:
    """At most one distinct observed state; an all-missing site counts as constant."""
    flat = (F.col("n_obs") == 0) | (F.col("min_state") == F.col("max_state"))
    return site_summary(cells, n_sites).filter(flat).select("site", F.col("n_obs"))


def constant_site_counts(cells: DataFrame, n_sites: int | None = None) -> DataFrame:
    """Numbers reported by :func:`drop_constant_sites`: eliminated (constant), all_missing."""
    return constant_sites(cells, n_sites).agg(
        F.count(F.when(F.col("n_obs") > 0, 1)).alias("eliminated"),
        F.count(F.when(F.col("n_obs") == 0, 1)).alias("all_missing"),
    )


def drop_constant_sites(cells: DataFrame) -> DataFrame:
    """Delete constant and all-missing columns and renumber the others from 0."""
    varying = site_summary(cells).filter(F.col("min_state") != F.col("max_state"))
    return select_sites(cells, varying)


def mask_like(cells: DataFrame, other: DataFrame) -> DataFrame:
    """Copy the missing pattern of ``other``: a cell missing there becomes null here."""
    seen = observed(other).select("taxon", "site", F.lit(True).alias("_seen"))
    return (
        cells.join(seen, ["taxon", "site"], "left")
        .withColumn("state", F.when(F.col("_seen"), F.col("state")))
        .drop("_seen")
    )


def activate_sites(cells: DataFrame, ranks: DataFrame, c1: int, c2: int) -> DataFrame:
    """Keep cells whose site has a rank in [c1, c2); all other cells become null."""
    return (
        cells.join(ranks.select("site", "site_rank"), "site", "left")
        .withColumn("state", F.when((F.col("site_rank") >= c1) & (F.col("site_rank") < c2), F.col("state")))
        .drop("site_rank")
    )


def assign_genes(cells: DataFrame, genes: DataFrame, width: int = 1024) -> DataFrame:
    """Range join site -> gene; gene limits are 1-based and inclusive, sites 0-based.

    Genes are cut at multiples of ``width`` so that the join is an equi-join on the
    block with a residual range condition.
    """
    blocks = genes.withColumn(
        "_blk",
        F.explode(F.sequence(F.floor((F.col("site_begin") - 1) / width), F.floor((F.col("site_end") - 1) / width))),
    )
    tagged = cells.withColumn("_blk", F.floor(F.col("site") / width))
    return (
        tagged.join(blocks, "_blk")
        .filter((F.col("site") >= F.col("site_begin") - 1) & (F.col("site") < F.col("site_end")))
        .drop("_blk")
    )


def gene_missing_fraction(cells: DataFrame, genes: DataFrame, n_taxa: Column | int) -> DataFrame:
    """Missing cells / all cells of each gene, counted from the observed cells.

    Cells are first counted per site, so the range join sees one row per site.
    """
    total = F.lit(n_taxa) if isinstance(n_taxa, int) else n_taxa
    per_site = observed(cells).groupBy("site").agg(F.count(F.lit(1)).alias("n_obs"))
    seen = assign_genes(per_site, genes).groupBy("gene").agg(F.sum("n_obs").alias("n_obs"))
    width = F.col("site_end") - F.col("site_begin") + 1
    return genes.join(seen, "gene", "left").select(
        "gene",
        "site_begin",
        "site_end",
        (1 - F.coalesce("n_obs", F.lit(0)) / (width * total)).alias("missing_frac"),
    )


def concatenate_genes(cells: DataFrame, kept: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sites of the kept genes, renumbered as one concatenated alignment.

    ``kept`` has (keys..., gene, site_begin, site_end); offsets are running sums of
    the gene lengths in gene order.
    """
    keys = keys or []
    size = (F.col("site_end") - F.col("site_begin") + 1).cast("bigint")
    placed = prefix_sum(kept, keys, ["gene"], F.floor(F.col("gene") / SITE_BUCKET), size, "offset")
    return assign_genes(cells, placed).withColumn(
        "site", (F.col("site") - (F.col("site_begin") - 1) + F.col("offset")).cast("int")
    ).drop("site_begin", "site_end", "offset")


def filter_genes_by_missing(
    cells: DataFrame, genes: DataFrame, max_frac: float, n_taxa: Column | int, exclude: DataFrame | None = None
) -> DataFrame:
    """Concatenate the non-excluded genes whose missing fraction is at most ``max_frac``."""
    fractions = gene_missing_fraction(cells, genes, n_taxa)
    if exclude is not None:
        fractions = fractions.join(exclude.select("gene"), "gene", "left_anti")
    kept = fractions.filter(F.col("missing_frac") <= max_frac).select("gene", "site_begin", "site_end")
    return concatenate_genes(cells, kept)


def recode(cells: DataFrame, scheme: DataFrame) -> DataFrame:
    """Map states to groups; a state without a group becomes missing."""
    return cells.join(F.broadcast(scheme), "state", "left").withColumn("state", F.col("recoded")).drop("recoded")


def match_taxa_prefix(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """Match each name with the taxon it begins, or else with the taxon that begins it.

    Two hits for a name raise. Prefixes of both sides are enumerated, so the theta
    join on ``startswith`` becomes an equi-join.
    """
    def prefixes(df: DataFrame, col: str) -> DataFrame:
        return df.select(
            col, F.explode(F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.substring(F.col(col), F.lit(1), i))).alias("_p")
        )

    names = names.select(F.col("name").cast("string").alias("name")).distinct()
    taxa = taxa.select(F.col("taxon").cast("string").alias("taxon")).distinct()
    forward = names.join(prefixes(taxa, "taxon"), F.col("name") == F.col("_p")).select("name", "taxon", F.lit(0).alias("_way"))
    backward = prefixes(names, "name").join(taxa, F.col("_p") == F.col("taxon")).select("name", "taxon", F.lit(1).alias("_way"))
    hits = (
        forward.unionByName(backward)
        .groupBy("name", "_way")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("taxon").alias("taxon"))
        .groupBy("name")
        .agg(F.min_by(F.struct("_n", "taxon"), "_way").alias("_h"))
    )
    unique = F.when(F.col("_h._n") > 1, F.raise_error(F.concat(F.lit("ambiguous taxon name: "), F.col("name")))).otherwise(F.col("_h.taxon"))
    return names.join(hits, "name", "left").select("name", unique.cast("string").alias("taxon"))
