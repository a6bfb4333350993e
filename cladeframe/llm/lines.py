"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

Batches arrive with falling ids. A batch is reduced to one row per line hash, which
is merge-anti-joined with the runs: a hash in no run is new, and its largest id in
the batch owns the line for good. The batch then becomes a sorted run of level 0.
When a level holds ``fan_out`` runs they are merged into one run of the next level,
document counts summed. Runs are partitioned and sorted by hash, so that joins and
merges with them need no further exchange.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import SPACES, durable

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def key_hash(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key, F.lit("line")).alias("h2"))


def _long_enough(line: Column, min_chars: int) -> Column:
    return F.char_length(F.trim(line, F.lit(SPACES))) >= min_chars


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levels of sorted runs with columns h1, h2, n (documents) and owner."""

    def __init__(self, fan_out: int = 3):
        self.fan_out = fan_out
        self.levels: list[list[DataFrame]] = []

    def _sorted(self, rows: DataFrame) -> DataFrame:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return durable(rows.repartition(n, *HASH).sortWithinPartitions(*HASH))

    def add(self, batch: DataFrame) -> None:
        """Add the keys of a batch: distinct rows (k, h1, h2), all k below those of earlier batches."""
        keys = batch.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("owner"))
        runs = [r for level in self.levels for r in level]
        if runs:
            keys = durable(keys)
            fresh = reduce(lambda left, run: left.join(run.select(*HASH), HASH, "left_anti"), runs, keys)
            held = fresh.select(*HASH, F.lit(True).alias("new"))
            keys = keys.join(held, HASH, "left").select(*HASH, "n", F.when(F.col("new"), F.col("owner")).alias("owner"))
        self._insert(0, self._sorted(keys))

    def _insert(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._insert(level + 1, self._sorted(merged))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, runs)
        return rows.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))

    def frequent(self, min_docs: int) -> DataFrame:
        """Hashes found in at least ``min_docs`` documents, with their owner."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs).filter(F.col("n") >= min_docs).select(*HASH, "owner")


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fan_out: int = 3,
) -> DataFrame:
    """All rows and columns of the input, with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    Lines whose key has at least ``min_chars`` code points and occurs in at least
    ``min_docs`` different ids lose all their lines except in the largest of these
    ids. ``batches`` ranges of ids enter one after another, the largest first.

    A null or empty text is one empty line and is kept as an empty text. Null ids
    count as one document, smaller than all others; rows that share an id are one
    document and all keep or lose the line together. An empty table gives no rows.
    Input columns with the names of the added ones are replaced.
    """
    lines = split_lines(F.col(text_col))
    keys = F.array_distinct(
        F.transform(F.filter(lines, lambda x: _long_enough(x, min_chars)), lambda x: key_hash(line_key(x)))
    )
    found = durable(
        df.select(F.col(id_col).alias("k"), F.explode(keys).alias("h")).select("k", "h.h1", "h.h2").distinct()
    )
    runs = LineRuns(fan_out)
    for batch in id_ranges(found, batches):
        runs.add(found.filter(batch))
    frequent = durable(runs.frequent(min_docs))
    lost = (
        found.join(frequent, HASH)
        .filter(~F.col("k").eqNullSafe(F.col("owner")))
        .groupBy("k")
        .agg(F.collect_list(F.struct(*HASH)).alias("_lost"))
        .withColumnRenamed("k", "_k")
    )
    extra = ["kept_text", "n_lines", "n_dropped", "_k", "_lost", "_kept"]
    kept = F.filter(
        lines,
        lambda x: ~(_long_enough(x, min_chars) & F.array_contains(F.col("_lost"), key_hash(line_key(x)))),
    )
    rows = df.drop(*[c for c in extra if c in df.columns])
    joined = rows.join(lost, F.col(id_col).eqNullSafe(F.col("_k")), "left")
    out = joined.withColumn("_kept", F.when(F.col("_lost").isNull(), lines).otherwise(kept))
    return out.select(
        *rows.columns,
        F.array_join("_kept", "\n").alias("kept_text"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size("_kept")).cast("bigint").alias("n_dropped"),
    )


def id_ranges(found: DataFrame, batches: int) -> list[Column]:
    """Conditions on k that cut the rows into about equal ranges, the largest first; nulls are in the last."""
    k = F.col("k")
    shares = [1 - i / batches for i in range(1, batches)]
    cuts = found.agg(F.percentile_approx("k", shares, 1000).alias("c")).first()["c"] if batches > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    if not cuts:
        return [F.lit(True)]
    out = [k >= cuts[0]]
    out += [(k < high) & (k >= low) for high, low in zip(cuts, cuts[1:], strict=False)]
    return [*out, (k < cuts[-1]) | k.isNull()]
