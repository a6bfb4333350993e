"""Deterministic replicate sampling by hash order.

A draw without replacement takes the items with the smallest digests of
``seed-rep-item``. Positions come from the bucketed ranking, so no task sorts a
whole replicate, and a rerun after a lost executor gives the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.ordered import position_in_group
from cladeframe.operators.alignment import concatenate_genes


def _digest(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _draw(items: DataFrame, item: str, keys: list[str], seed: int, size: Column, name: str) -> DataFrame:
    """Items whose hash position within ``keys`` is below ``size``."""
    hashed = items.withColumn("_h", _digest(seed, *[F.col(k) for k in keys], F.col(item)))
    placed = position_in_group(hashed, keys, ["_h"], F.substring("_h", 1, 2), name)
    return placed.filter(F.col(name) < size).drop("_h")


def with_replicates(items: DataFrame, reps: int) -> DataFrame:
    return items.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def cv_replicates(sites: DataFrame, n1: int, n2: int, reps: int, seed: int = 0) -> DataFrame:
    """(rep, site, role, new_site): n1 learning and n2 test sites per replicate, in site order."""
    drawn = _draw(with_replicates(sites.select("site").distinct(), reps), "site", ["rep"], seed, F.lit(n1 + n2), "_at")
    roles = drawn.withColumn("role", F.when(F.col("_at") < n1, "learn").otherwise("test")).drop("_at")
    return position_in_group(roles, ["rep", "role"], ["site"], F.floor(F.col("site") / 4096), "new_site")


def replicate_cells(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cells of each replicate data set with the replicate's own site numbers."""
    return cells.join(chosen, "site").withColumn("site", F.col("new_site").cast("int")).drop("new_site")


def jackknife_genes(genes: DataFrame, n: int, reps: int, seed: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """(rep, gene, site_begin, site_end): ``n`` genes without replacement per replicate."""
    usable = genes if exclude is None else genes.join(exclude.select("gene"), "gene", "left_anti")
    return _draw(with_replicates(usable, reps), "gene", ["rep"], seed, F.lit(n), "_at").drop("_at")


def gene_jackknife(
    cells: DataFrame, genes: DataFrame, n: int, reps: int, seed: int = 0, exclude: DataFrame | None = None
) -> DataFrame:
    """Replicate alignments of ``n`` genes each, concatenated in their original order."""
    return concatenate_genes(cells, jackknife_genes(genes, n, reps, seed, exclude), ["rep"])


def site_ranks(sites: DataFrame, random: bool, seed: int = 0) -> DataFrame:
    """(site, site_rank): identity or a random permutation of the sites."""
    sites = sites.select("site").distinct()
    if not random:
        return position_in_group(sites, [], ["site"], F.floor(F.col("site") / 4096), "site_rank")
    hashed = sites.withColumn("_h", _digest(seed, F.col("site")))
    return position_in_group(hashed, [], ["_h"], F.substring("_h", 1, 2), "site_rank").drop("_h")


def site_subsets(sites: DataFrame, sizes: list[tuple[int, int]], seed: int = 0) -> DataFrame:
    """(k, rep, site): for every (k, reps) of ``sizes``, ``reps`` random subsets of k sites."""
    plan = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("reps")) for k, r in sizes])
    spread = (
        sites.select("site").distinct()
        .withColumn("_p", F.explode(plan))
        .select("site", "_p.k", F.explode(F.sequence(F.lit(0), F.col("_p.reps") - 1)).alias("rep"))
    )
    return _draw(spread, "site", ["k", "rep"], seed, F.col("k"), "_at").select("k", "rep", "site")
