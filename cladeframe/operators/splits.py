"""Split frequencies, run comparison and greedy consensus.

``splits(run, iter, split, length)`` holds canonical splits; ``trees(run, n_trees)``
gives the number of trees of each run.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.ordered import ranked
from cladeframe.functions.splits import canonical_split, informative
from cladeframe.operators.splitindex import clashing, conflict_pairs, conflicting_splits, index_of
from cladeframe.session import durable

# Candidates decided by one task of a consensus round.
BLOCK = 2_000


def tree_counts(trees: DataFrame) -> DataFrame:
    return trees.groupBy("run").agg(F.count(F.lit(1)).alias("n_trees"))


def split_freq(splits: DataFrame, trees: DataFrame) -> DataFrame:
    """Per (run, split): trees that have it, share of the run's trees, mean length over them."""
    counted = splits.groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    return counted.join(trees, "run").select("run", "split", "n", (F.col("n") / F.col("n_trees")).alias("prob"), "mean_length")


def merge_runs(freq: DataFrame, trees: DataFrame) -> DataFrame:
    """One list over all runs: weights, summed lengths and totals add up."""
    everything = trees.agg(F.sum("n_trees").alias("_t")).scalar()
    return freq.groupBy("split").agg(
        F.sum("n").alias("n"), (F.sum(F.col("mean_length") * F.col("n")) / F.sum("n")).alias("mean_length")
    ).select("split", "n", (F.col("n") / everything).alias("prob"), "mean_length")


def split_matrix(freq: DataFrame) -> DataFrame:
    """(split, run, prob, mean_length) for every split and run, zeros where a run lacks the split.

    The list of runs is a scalar; each split looks its own runs up in a map.
    """
    runs = freq.agg(F.array_sort(F.collect_set("run"))).scalar()
    by_split = freq.groupBy("split").agg(
        F.map_from_entries(F.collect_list(F.struct("run", F.struct("prob", "mean_length")))).alias("_m")
    )
    filled = by_split.select("split", "_m", F.explode(runs).alias("run"))
    hit = F.col("_m")[F.col("run")]
    return filled.select(
        "split", "run", F.coalesce(hit["prob"], F.lit(0.0)).alias("prob"), F.coalesce(hit["mean_length"], F.lit(0.0)).alias("mean_length")
    )


def compare_runs_splits(freq: DataFrame, n_runs: int | Column | None = None) -> DataFrame:
    """Per split: maxdiff and mean difference over all run pairs, mean probability over runs.

    Sorted probabilities give the sum of pair differences as sum of (2 rank - R - 1) p,
    with absent runs as zeros of the lowest ranks, so pairs are never formed.
    """
    if n_runs is None:
        n_runs = freq.agg(F.count_distinct("run")).scalar()
    total = F.lit(n_runs) if isinstance(n_runs, int) else n_runs
    ranked = freq.withColumn("_r", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("prob"))))
    # rank from below = R + 1 - rank from above
    weight = total + 1 - 2 * F.col("_r")
    pairs = total * (total - 1) / 2
    return ranked.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_present"),
        F.max("prob").alias("_hi"),
        F.min("prob").alias("_lo"),
        F.coalesce(F.try_divide(F.sum(weight * F.col("prob")), F.first(pairs)), F.lit(0.0)).alias("mean_diff"),
        (F.sum("prob") / F.first(total)).alias("mean_prob"),
        F.first(total).alias("_total"),
    ).select(
        "split",
        (F.col("_hi") - F.when(F.col("n_present") < F.col("_total"), 0.0).otherwise(F.col("_lo"))).alias("maxdiff"),
        "mean_diff", "mean_prob", "n_present",
    )


def overall_difference(comparison: DataFrame) -> DataFrame:
    """Largest maxdiff, and mean difference weighted by the mean probability."""
    return comparison.agg(
        F.count(F.lit(1)).alias("n_splits"),
        F.max("maxdiff").alias("maxdiff"),
        (F.sum(F.col("mean_prob") * F.col("mean_diff")) / F.sum("mean_prob")).alias("meandiff"),
    )


def split_vs_reference(freq: DataFrame, ref: DataFrame) -> DataFrame:
    """Frequencies with refprob and reflength of a reference list, 0 where it lacks the split."""
    right = ref.select("split", F.col("prob").alias("refprob"), F.col("mean_length").alias("reflength"))
    return freq.join(right, "split", "left").fillna(0.0, ["refprob", "reflength"])


def compare_to_reference(freq: DataFrame, ref: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Splits of the runs or the reference whose mean probability differs from it by more than ``threshold``."""
    mine = compare_runs_splits(freq)
    right = ref.select("split", F.col("prob").alias("refprob"), F.col("mean_length").alias("reflength"))
    both = mine.join(right, "split", "full").fillna(0.0, ["maxdiff", "mean_diff", "mean_prob", "refprob", "reflength"])
    return both.withColumn("refdiff", F.abs(F.col("refprob") - F.col("mean_prob"))).filter(F.col("refdiff") > threshold)


def informative_splits(splits: DataFrame, n_taxa: int | Column) -> DataFrame:
    return splits.filter(informative(F.col("split"), n_taxa))


def truncate_splits(freq: DataFrame, cutoff: float) -> DataFrame:
    return freq.filter(F.col("prob") >= cutoff)


def top_splits(freq: DataFrame, cutoff: float, k: int | None = None) -> DataFrame:
    """Splits at or above ``cutoff`` with their rank by falling probability; ``k`` makes it a top-k report."""
    kept = truncate_splits(freq, cutoff)
    if k is None:
        return rank_splits(kept, "prob")
    first = kept.orderBy(F.desc("prob"), "split").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("prob"), "split")))  # k rows


def rank_splits(df: DataFrame, by: str) -> DataFrame:
    """Adds ``rank``: position by falling ``by``, ties by split."""
    return ranked(df, [F.desc(by), F.asc("split")], "rank")


def split_histogram(freq: DataFrame, n_bins: int) -> DataFrame:
    """Splits per probability bin; probability 1 falls in the last bin."""
    bins = F.least(F.floor(F.col("prob") * n_bins), F.lit(n_bins - 1)).cast("int")
    return freq.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def splits_equal(a: DataFrame, b: DataFrame, tol: float = 1e-6) -> DataFrame:
    """One row: number of differing splits and whether the two lists agree within ``tol``."""
    left = a.select("split", F.col("prob").alias("pa"), F.col("mean_length").alias("la"))
    right = b.select("split", F.col("prob").alias("pb"), F.col("mean_length").alias("lb"))
    near = (F.abs(F.col("pa") - F.col("pb")) <= tol) & (F.abs(F.col("la") - F.col("lb")) <= tol)
    joined = left.join(right, "split", "full")
    wrong = F.count(F.when(F.coalesce(near, F.lit(False)), None).otherwise(1))
    return joined.agg(wrong.alias("n_different"), (wrong == 0).alias("equal"))


def check_split_duplicates(freq: DataFrame, taxa: Column) -> DataFrame:
    """Splits that occur more than once after orientation (duplicates and complements)."""
    return (
        freq.withColumn("split", canonical_split(F.col("split"), taxa))
        .groupBy("run", "split").agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def restrict_splits(splits: DataFrame, keep: Column) -> DataFrame:
    """Project splits on the sorted taxon array ``keep``; trivial ones vanish, equal ones of a tree merge."""
    cut = splits.withColumn("split", canonical_split(F.array_intersect(F.col("split"), keep), keep))
    return cut.filter(F.size("split") > 0).groupBy("run", "iter", "split").agg(F.sum("length").alias("length"))


def split_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` with (split_b, prob_b) of every canonical split of ``b`` that is incompatible with it."""
    return conflict_pairs(a, b)


def compatible_with(a: DataFrame, b: DataFrame) -> DataFrame:
    """Splits of ``a`` that conflict with no split of ``b``."""
    return a.join(conflicting_splits(a, b), "split", "left_anti")


def restricted_freq(splits: DataFrame, trees: DataFrame, shared: Column) -> DataFrame:
    """Split frequencies of trees cut down to the shared taxa.

    Every tree's splits are projected first, so splits of different trees that fall
    together count as the one split that these trees share.
    """
    return split_freq(restrict_splits(splits, shared), trees)


def split_support(a: DataFrame, b: DataFrame) -> DataFrame:
    """Probability in ``b`` of every split of ``a``; both lists are on the same taxa."""
    right = b.select("split", F.col("prob").alias("support"))
    return a.select("split", "prob").join(right, "split", "left").fillna(0.0, ["support"])


def split_compat_with(a: DataFrame, b: DataFrame) -> DataFrame:
    """Splits of ``a`` with the number and best probability of conflicting splits of ``b``."""
    mine = a.select("split", "prob")
    clashes = split_conflicts(mine, b).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_conflicts"), F.max("prob_b").alias("max_conflict")
    )
    return mine.join(clashes, "split", "left").fillna(0, ["n_conflicts", "max_conflict"])


def compatible_runs(taxa: DataFrame) -> DataFrame:
    """Compare every run's taxa (run, taxon) with those of the first run: sizes, common taxa, usable."""
    taxa = taxa.select("run", "taxon").distinct()
    lead_run = taxa.agg(F.min("run")).scalar()
    base = taxa.filter(F.col("run") == lead_run).select("taxon", F.lit(1).alias("_hit"))
    size = base.agg(F.count(F.lit(1))).scalar()
    return (
        taxa.join(base, "taxon", "left")
        .groupBy("run")
        .agg(F.count(F.lit(1)).alias("n_taxa"), F.count("_hit").alias("n_common"))
        .withColumn("compatible", (F.col("n_taxa") == F.col("n_common")) & (F.col("n_common") == size))
    )


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Accept ranked splits one after the other when no accepted one conflicts."""
    taken: list[set] = []
    keep = []
    for i, members in zip(pdf.sort_values("rank").index, pdf.sort_values("rank")["split"], strict=True):
        s = set(members)
        if all(not (s & t) or s <= t or t <= s for t in taken):
            taken.append(s)
            keep.append(i)
    return pdf.loc[keep, ["split", "n", "prob", "mean_length"]]


def consensus_splits(merged: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Greedy consensus: by falling probability, keep splits compatible with all kept before.

    Splits above one half are always compatible and need no comparison. The rest is
    decided in blocks of rank order: a block that no kept split rules out is resolved
    by one task, then every later candidate is checked against what the block added.
    """
    columns = ["split", "n", "prob", "mean_length"]
    (listed,) = index_of(merged.select(*columns).filter(F.col("prob") >= cutoff))
    fresh = listed.filter("prob > 0.5")  # kept since the candidates were last checked
    kept = fresh
    rest = listed.filter("prob <= 0.5")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("prob"), "split"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.select(*columns).schema.fields)
    while True:
        rest = durable(rest.join(clashing(rest, fresh), "split", "left_anti").select(*listed.columns))
        block = rest.select(*columns).orderBy(F.desc("prob"), "split").limit(BLOCK).withColumn("rank", rank)
        chosen = block.withColumn("_block", F.lit(0)).groupBy("_block").applyInPandas(_greedy, schema)
        chosen = durable(rest.join(chosen.select("split"), "split", "left_semi").select(*listed.columns))
        kept = kept.unionByName(chosen)
        last = block.agg(F.max_by("split", "rank").alias("s"), F.max("rank").alias("n"), F.min("prob").alias("p")).first()
        if not last["n"] or last["n"] < BLOCK:
            return kept.select(*columns)
        # the next candidates stand behind the last of this block
        rest = rest.filter((F.col("prob") < last["p"]) | ((F.col("prob") == last["p"]) & (F.col("split") > F.lit(last["s"]))))
        fresh = chosen


def consensus_nodes(kept: DataFrame, taxa: DataFrame) -> DataFrame:
    """Tree nodes of compatible canonical splits, rooted at the first taxon.

    Canonical splits leave the first taxon out, so compatible ones are nested. The
    clades that hold a taxon form a chain ordered by size, and the next one in the
    chain is the parent; every clade reads its parent off its smallest taxon.
    """
    names = taxa.select(F.col("taxon")).distinct()
    first = names.agg(F.min("taxon")).scalar()
    n_taxa = names.agg(F.count(F.lit(1))).scalar()
    clades = kept.filter((F.size("split") >= 2) & (F.size("split") < n_taxa - 1))
    tips = kept.filter(F.size("split") == 1).select(F.col("split")[0].alias("taxon"), F.col("mean_length").alias("_tip"))
    stem = kept.filter((F.size("split") == n_taxa - 1) & (n_taxa > 2)).agg(F.max("mean_length")).scalar()
    leaves = names.join(tips, "taxon", "left").select(
        "taxon", F.when(F.col("taxon") == first, stem).otherwise(F.col("_tip")).alias("length")
    )
    label = F.array_join(F.col("split").cast("array<string>"), "|")
    members = clades.select(label.alias("node"), F.size("split").alias("size"), F.explode("split").alias("taxon"), "mean_length", "prob")
    chain = members.select("node", "size", "taxon", F.col("mean_length").alias("length"), F.col("prob").alias("support"), F.lit(None).cast("string").alias("leaf")).unionByName(
        leaves.select(
            F.col("taxon").cast("string").alias("node"), F.lit(1).alias("size"), "taxon", "length",
            F.lit(None).cast("double").alias("support"), F.col("taxon").cast("string").alias("leaf"),
        )
    )
    up = Window.partitionBy("taxon").orderBy("size")
    linked = chain.withColumn("parent", F.coalesce(F.lead("node").over(up), F.lit("root")))
    nodes = linked.groupBy("node").agg(
        F.min_by("parent", "taxon").alias("parent"), F.first("leaf", ignorenulls=True).alias("taxon"),
        F.first("length", ignorenulls=True).alias("length"), F.first("support", ignorenulls=True).alias("support"),
    )
    root = names.sparkSession.range(1).select(
        F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("taxon"),
        F.lit(None).cast("double").alias("length"), F.lit(None).cast("double").alias("support"),
    )
    return nodes.unionByName(root)
