"""Shared helpers: table access, lineage cuts, tokenizer files and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.session import durable

__all__ = ["durable", "read", "release", "shared_folder", "id_type", "code_points", "tokenizer_path", "components", "SPACES"]

#: The white space of every word and line rule: \x20 and \x09 to \x0D.
SPACES = "\t\n\x0b\x0c\r "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give what a Python worker has freed back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that the cluster names; a local session may have one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cladeframe-")
    return folder.rstrip("/")


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def code_points(text: Column) -> Column:
    return F.char_length(text).cast("bigint")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; ``TOKENIZER_DIR`` names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components: rows (node, root), root the smallest node reachable.

    ``edges`` has columns a and b of one orderable type; a node without an edge to
    another node has no row. Alternates large-star and small-star rounds: every
    round is a grouping without a gathered list, so a hub is never held in one
    task, and the number of rounds grows with the logarithm of the diameter.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def hook(e: DataFrame, keep: Column) -> DataFrame:
        """Link the neighbours of every node that pass ``keep`` to the node's minimum."""
        sided = both(e)
        low = sided.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return (
            sided.join(low, "a")
            .filter(keep)
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        )

    current = durable(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    for _ in range(max_rounds):
        large = hook(current, F.col("b") > F.col("a")).distinct()
        # small star: the smaller neighbours of a node, and the node, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        following = durable(
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .filter("a <> b")
            .distinct()
        )
        unsettled = following.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        roots = following.select(F.col("b").alias("a")).distinct()
        if unsettled.isEmpty() and following.join(roots, "a", "left_semi").isEmpty():
            current = following
            break
        current = following
    else:
        raise RuntimeError("components did not settle")
    own = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(own)
