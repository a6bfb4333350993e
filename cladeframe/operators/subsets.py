"""Random site subsets without ranking, and scores over very many of them.

A subset is the first k images of a keyed permutation of 0 .. n - 1: balanced Feistel rounds
on the next even number of bits, walked on until the image is below n. So it costs k steps
instead of an order of all sites, any part of it can be made anywhere, and a lost task makes
the same one again. Sums over subsets are gathered from blocks of the site x draw matrix:
a block holds all sites and some draws, and meets every subset once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.ordered import position_in_group
from cladeframe.session import durable

_ROUNDS = 6
#: Entries of a matrix block; subset members gathered at once.
BLOCK_CELLS = 1 << 21
GATHERED = 1 << 18
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit number spread over all bits."""
    with np.errstate(over="ignore"):
        x = (x + _MIX[0]).astype(np.uint64)
        x = (x ^ x >> np.uint64(30)) * _MIX[1]
        x = (x ^ x >> np.uint64(27)) * _MIX[2]
    return x ^ x >> np.uint64(31)


def subset_keys(seed: int, k: int, reps: np.ndarray) -> np.ndarray:
    """One key per replicate."""
    first = mixed(np.array([seed % (1 << 64)], np.uint64)) ^ np.uint64(k)
    return mixed(mixed(first) ^ reps.astype(np.uint64))


def permuted(x: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Images of numbers below ``n`` under the permutations of their keys."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    out = x.astype(np.uint64)
    todo = np.arange(out.size)
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for r in range(_ROUNDS):
            with np.errstate(over="ignore"):
                turned = mixed(right + keys[todo] + np.uint64(r) * _MIX[1]) & low
            left, right = right, left ^ turned
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def subset_members(n: int, k: int, reps: np.ndarray, seed: int) -> np.ndarray:
    """Rows of ``k`` distinct numbers below ``n``, one row per replicate."""
    keys = np.repeat(subset_keys(seed, k, reps), k)
    return permuted(np.tile(np.arange(k), len(reps)), keys, n).reshape(len(reps), k)


def _chunks(spark, sizes: list[tuple[int, int]]) -> DataFrame:
    """(chunk, k, first, last): replicates in ranges of about ``GATHERED`` members."""
    rows = [(k, reps, max(1, GATHERED // k)) for k, reps in sizes]
    ranges = spark.createDataFrame(rows, "k bigint, reps bigint, step bigint")
    firsts = ranges.filter("reps > 0").select("k", "reps", "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("reps") - 1, F.col("step"))).alias("first"))
    return firsts.select(F.xxhash64("k", "first").alias("chunk"), "k", "first", F.least(F.col("first") + F.col("step"), "reps").alias("last"))


def keyed_subsets(sites: DataFrame, sizes: list[tuple[int, int]], seed: int = 0) -> DataFrame:
    """(k, rep, site): for every (k, reps) of ``sizes``, ``reps`` random subsets of k sites."""
    numbered = durable(position_in_group(sites.select("site").distinct(), [], ["site"], F.floor(F.col("site") / 4096), "no"))
    n = numbered.count()

    def draw(batches):
        for batch in batches:
            for k, first, last in zip(batch["k"], batch["first"], batch["last"], strict=True):
                reps = np.arange(first, last)
                members = subset_members(n, int(k), reps, seed)
                yield pd.DataFrame({"k": k, "rep": np.repeat(reps, int(k)), "no": members.ravel()})

    drawn = _chunks(sites.sparkSession, [(k, r) for k, r in sizes if k <= n]).repartition("chunk").select("k", "first", "last").mapInPandas(draw, "k bigint, rep bigint, no bigint")
    return drawn.join(numbered, "no").select("k", "rep", "site")


def _scores(matrix: np.ndarray, there: np.ndarray | None, k: int, first: int, last: int, n: int, seed: int) -> pd.DataFrame:
    """Per replicate: points, largest score, sums of exp, exp squared, score and score squared above it."""
    reps = np.arange(first, last)
    members = subset_members(n, k, reps, seed)
    draws = matrix.shape[1]
    total = np.zeros((len(reps), draws))
    seen = np.ones((len(reps), draws), bool) if there is None else np.zeros((len(reps), draws), bool)
    for j in range(k) if k < len(reps) else ():
        total += matrix[members[:, j]]
        if there is not None:
            seen |= there[members[:, j]]
    if k >= len(reps):
        for i, row in enumerate(members):
            total[i] = matrix[row].sum(0)
            if there is not None:
                seen[i] = there[row].any(0)
    total[~seen] = -np.inf
    top = total.max(1)
    kept = np.where(seen, total, 0.0)
    above = np.exp(total - np.where(np.isfinite(top), top, 0.0)[:, None])
    return pd.DataFrame({
        "k": k, "rep": reps, "n": seen.sum(1), "top": top, "e1": above.sum(1), "e2": (above**2).sum(1), "s1": kept.sum(1), "s2": (kept**2).sum(1),
    })


def subset_curve(site_logl: DataFrame, sizes: list[tuple[int, int]], seed: int = 0) -> DataFrame:
    """The cross-validation curve of :func:`fit.cv_subset_curve` over keyed subsets of the sites.

    ``site_logl`` is (run, iter, site, logl); a subset's score at a draw is the sum over its
    sites that have the draw. ``sizes`` lists (k, number of subsets), such as the whole
    schedule of :func:`fit.curve_sizes`.
    """
    spark = site_logl.sparkSession
    numbered = durable(position_in_group(site_logl.select("site").distinct(), [], ["site"], F.floor(F.col("site") / 4096), "no"))
    n = numbered.count()
    wide = max(1, min(64, BLOCK_CELLS // max(1, n)))
    cells = site_logl.join(numbered, "site").select("run", F.floor(F.col("iter") / wide).alias("block"), (F.col("iter") % wide).alias("at"), "no", "logl")
    cells = durable(cells)
    blocks = cells.select("run", "block").distinct()
    shards = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, blocks.count())))
    chunks = _chunks(spark, [(k, r) for k, r in sizes if k <= n])
    shard = F.pmod(F.col("chunk"), F.lit(shards))
    left = cells.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = blocks.agg(F.collect_list(F.struct("run", "block"))).scalar()  # one entry per run and ``wide`` draws
    right = chunks.select("k", "first", "last", shard.cast("int").alias("shard"), F.explode(keys).alias("b")).select("k", "first", "last", "shard", "b.run", "b.block")
    run_type = site_logl.schema["run"].dataType.simpleString()

    def solve(matrix: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((n, wide))
        there = np.zeros((n, wide), bool)
        place = matrix["no"].to_numpy(), matrix["at"].to_numpy()
        held[place], there[place] = matrix["logl"].to_numpy(), True
        used = there.any(0)
        held, there = held[:, used], there[:, used]
        dense = None if there.all() else there
        made = [_scores(held, dense, int(k), int(a), int(b), n, seed) for k, a, b in zip(parts["k"], parts["first"], parts["last"], strict=True)]
        if not made or matrix.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return pd.concat(made, ignore_index=True).assign(run=matrix["run"].iloc[0])

    schema = f"run {run_type}, k bigint, rep bigint, n bigint, top double, e1 double, e2 double, s1 double, s2 double"
    parts = left.groupBy("run", "block", "shard").cogroup(right.groupBy("run", "block", "shard")).applyInPandas(solve, schema).filter("n > 0")
    whole = parts.groupBy("run", "k", "rep").agg(
        F.sum("n").alias("n"), F.max("top").alias("top"), F.collect_list(F.struct("top", "e1", "e2")).alias("_p"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")
    )

    def scaled(name: str, power: int):
        return F.aggregate("_p", F.lit(0.0), lambda s, p: s + p[name] * F.exp(power * (p["top"] - F.col("top"))))

    e1, e2, m = scaled("e1", 1), scaled("e2", 2), F.col("s1") / F.col("n")
    logs = whole.select(
        "run", "k", "rep", "n", (F.col("top") + F.log(e1 / F.col("n"))).alias("log_mean_exp"), (e1 * e1 / e2).alias("ess"), m.alias("mean"),
        F.greatest(F.col("s2") / F.col("n") - m * m, F.lit(0.0)).alias("var"),
    )
    size = F.col("n")
    v = size / F.col("ess") - 1
    return logs.groupBy("run", "k").agg(
        F.count(F.lit(1)).alias("n_subsets"), F.avg(F.col("log_mean_exp") / F.col("k")).alias("cv"), F.avg(v / 2 / size).alias("bias"), F.avg(v / size).alias("var"),
        F.avg((F.exp("var") - 1) / size).alias("var_lognormal"), F.avg("mean").alias("mean_logl"), F.avg("var").alias("var_logl"),
        F.avg("ess").alias("mean_ess"), F.min("ess").alias("min_ess"),
    )
