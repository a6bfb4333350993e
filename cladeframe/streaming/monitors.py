"""Structured Streaming monitors over growing tables.

Nothing here has event time: a point is known by (run, iter), and one delivered twice
is dropped; the numbers seen are kept as intervals, see :mod:`seen`. The monitors keep plain mergeable aggregates as state, so they survive a
restart from the query's checkpoint and combine on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.logspace import band, band_sums, combine_bands
from cladeframe.operators.splits import compare_runs_splits, overall_difference
from cladeframe.operators.trace import running_moments
from cladeframe.operators.trees import tree_splits
from cladeframe.streaming.seen import first_time

TRACE = "run string, iter bigint, param string, value double"
TREES = "run string, iter bigint, newick string"
DELTAS = "run string, cycle bigint, draw bigint, delta double"


def read_growing(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Stream of Parquet files that keep arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_trace(trace: DataFrame) -> DataFrame:
    """Running n, mean and variance of every series (update mode)."""
    return running_moments(first_time(trace, ["run", "param"], "iter"))


def stream_splits(trees: DataFrame) -> DataFrame:
    """Running split counts per run; the count of the empty split is the number of trees (complete mode).

    Every tree has one empty split beside its own ones, so counts and totals come from
    one stateful aggregation.
    """
    splits = tree_splits(first_time(trees, ["run"], "iter"), count_trees=True)
    return splits.groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))


def split_snapshot(counts: DataFrame) -> DataFrame:
    """Split frequencies from the running counts of :func:`stream_splits`."""
    trees = counts.filter(F.size("split") == 0).select("run", F.col("n").alias("n_trees"))
    return counts.filter(F.size("split") > 0).join(trees, "run").select(
        "run", "split", "n", (F.col("n") / F.col("n_trees")).alias("prob"), "mean_length"
    )


def watch_splits(trees: DataFrame, report: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that reports the difference between runs after every trigger.

    Memory and broadcast are untouched; ``report`` gets a one-row DataFrame.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        report(overall_difference(compare_runs_splits(split_snapshot(batch))), epoch)

    return (
        stream_splits(trees).writeStream.outputMode("complete").foreachBatch(each)
        .option("checkpointLocation", checkpoint).start()
    )


def stream_logz(deltas: DataFrame) -> DataFrame:
    """Running band sums of the increments per (run, cycle) (update or complete mode).

    The scale of a band is fixed, so a late larger increment opens a new band instead
    of rescaling what was summed, and one key may be summed by many tasks.
    """
    fresh = first_time(deltas, ["run", "cycle"], "draw")
    x = F.col("delta")
    return fresh.groupBy("run", "cycle", band(x).alias("_band")).agg(*band_sums(x))


def logz_snapshot(bands: DataFrame) -> DataFrame:
    """logz, mean, variance, n and ESS from the bands of :func:`stream_logz`."""
    return combine_bands(bands, ["run", "cycle"]).select(
        "run", "cycle", F.col("log_mean_exp").alias("logz"), F.col("mean").alias("meanlogp"), F.col("var").alias("varlogp"), F.col("n").alias("npoint"), "ess"
    )
