"""Ordered analytics that do not put a whole group into one task.

A plain window over a run or a site sorts that group in one task, and one group
may hold a third of the data. These helpers cut every group into order-preserving
buckets: the window runs inside ``(keys, bucket)`` and only one row per bucket
takes part in the pass over the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.session import durable


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same ``keys``.

    ``bucket`` must not decrease along ``order``.
    """
    keys = list(keys)
    tagged = df.withColumn("_b", bucket).withColumn("_v", value)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_b")
        .agg(F.sum("_v").alias("_t"))
        .select(*keys, "_b", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_off"))
    )
    return (
        tagged.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
        .join(offsets, [*keys, "_b"])
        .withColumn(name, F.col("_in") + F.col("_off"))
        .drop("_b", "_v", "_in", "_off")
    )


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str
) -> DataFrame:
    """Zero-based position of every row within ``keys``."""
    return prefix_sum(df, keys, order, bucket, F.lit(1).cast("bigint"), name)


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Position of every row in ``order`` over the whole table, from 1.

    Ranges of the order become partitions; a row's position is that in its range and the
    rows of the ranges before. Rows equal in ``order`` get positions in any order.
    """
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()))
    part = F.shiftright("_i", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    offsets = parts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_off") + F.col("_i").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").select(*df.columns, place.alias(name))


def next_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    columns: dict[str, str],
) -> DataFrame:
    """Values of the next row within ``keys``; ``columns`` maps new name to source.

    Inside a bucket this is ``lead``; the last row of a bucket takes the first
    row of the next non-empty bucket.
    """
    keys = list(keys)
    tagged = df.withColumn("_b", bucket)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy("_b")
    payload = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    heads = (
        tagged.groupBy(*keys, "_b")
        .agg(F.min_by(payload, F.struct(*order)).alias("_h"))
        .select(*keys, "_b", F.lead("_h").over(outer).alias("_h"))
    )
    return (
        tagged.withColumn("_n", F.lead(payload).over(inner))
        .join(heads, [*keys, "_b"])
        .select(
            *df.columns,
            *[F.coalesce(F.col("_n")[new], F.col("_h")[new]).alias(new) for new in columns],
        )
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Column],
    n_buckets: int = 128,
) -> DataFrame:
    """Exact order statistics: one row per ``keys``, one column per entry of ``ranks``.

    A rank is a zero-based index written over the column ``n`` (the group size).
    Equal values are counted first. Approximate quantiles of a group's distinct
    values, sought by halves, cut it into buckets of about equal size, wherever its outliers lie; the
    bucket of each rank is found, and only the values of that bucket are sorted.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    shares = [i / n_buckets for i in range(1, n_buckets)]
    spans = counts.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.array_sort(F.array_distinct(F.percentile_approx(value, shares, 20 * n_buckets))).alias("_cuts")
    )
    # the cuts below a value, halved again and again: a key's rows may lie in one task
    placed = counts.join(spans, keys).withColumn("_b", F.lit(0))
    for step in (1 << i for i in reversed(range((n_buckets - 1).bit_length()))):
        below = F.coalesce(F.get("_cuts", F.col("_b") + (step - 1)) < F.col(value), F.lit(False))
        placed = placed.withColumn("_b", F.when(below, F.col("_b") + step).otherwise(F.col("_b")))
    placed = placed.drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[r.cast("bigint") for r in ranks.values()])
    buckets = (
        placed.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_t"), F.first("n").alias("n"))
        .withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        .withColumn("_hit", F.filter(wanted, lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_t"))))
        .filter(F.size("_hit") > 0)
        .select(*keys, "_b", "_off")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        placed.join(buckets, [*keys, "_b"])
        .withColumn("_at", F.col("_off") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    )
    picks = [
        F.max(F.when((r.cast("bigint") >= F.col("_at")) & (r.cast("bigint") < F.col("_at") + F.col("_c")), F.col(value))).alias(name)
        for name, r in ranks.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
