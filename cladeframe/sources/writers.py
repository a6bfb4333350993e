"""Sinks: alignment text, posterior tables and trees.

A line of an alignment is one value, so each taxon's sites meet in one row when a
text file is written; that is the file format, not an intermediate step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., start, text, n, w): cells that lie behind one another in a task, in site order and of one width ``w``, as one text.

    Missing cells give rows with ``n`` zero, at least one for every key that has some.
    """
    named = cells.select(*keys, F.col("site").cast("int").alias("site"), "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            site, state = batch.column("site"), batch.column("state").cast(pa.string())
            there = np.asarray(state.is_valid())
            known = there & np.asarray(site.is_valid())
            at, wide = np.asarray(site.fill_null(0)), np.asarray(pc.utf8_length(state).fill_null(0))
            follows = (at[1:] == at[:-1] + 1) & (wide[1:] == wide[:-1]) & known[1:] & known[:-1] | ~(there[1:] | there[:-1])
            for k in keys:
                column = batch.column(k)
                follows &= np.asarray(pc.equal(column[1:], column[:-1]).fill_null(False))
            first = np.concatenate([[0], np.flatnonzero(~follows) + 1])
            ends = np.append(first[1:], batch.num_rows)
            texts = state.fill_null("")
            cuts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:][np.append(first, batch.num_rows)]
            text = pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts), texts.buffers()[2] or pa.py_buffer(b""))
            n, taken = np.where(there[first], ends - first, 0), pa.array(first)
            columns = [batch.column(k).take(taken) for k in keys] + [site.take(taken), text, pa.array(n, pa.int32()), pa.array(wide[first], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "start", "text", "n", "w"])

    kinds = ", ".join(f"`{k}` {named.schema[k].dataType.simpleString()}" for k in keys)
    return named.mapInArrow(run, f"{kinds}, start int, text string, n int, w int")


def alignment_lines(cells: DataFrame, n_sites: int, keys: list[str] | None = None, width: int = 1, in_rows: bool = False) -> DataFrame:
    """(keys..., taxon, seq): states in site order, '-' (``width`` of them) where missing.

    Observed sites are sorted per taxon and the gaps between them are filled with
    repeated dashes, so missing cells need no rows. ``in_rows``: most cells of a taxon come one behind the
    other, as a reader gives them; they are put together before the shuffle.
    """
    keys = [*(keys or []), "taxon"]
    dash = "-" * width
    if in_rows:
        return _lines_of_runs(cell_runs(cells, keys), n_sites, keys, dash)
    filled = cells.filter(F.col("state").isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("site").cast("int").alias("site"), "state"))).alias("_c")
    )
    everyone = cells.select(*keys).distinct().join(filled, keys, "left")
    gaps = F.transform(F.col("_c"), lambda cell, i: F.concat(
        F.repeat(F.lit(dash), cell["site"] - F.when(i == 0, 0).otherwise(F.get(F.col("_c"), i - 1)["site"] + 1)), cell["state"]))
    tail = F.repeat(F.lit(dash), F.lit(n_sites) - F.coalesce(F.get(F.col("_c"), F.size("_c") - 1)["site"] + 1, F.lit(0)))
    return everyone.select(*keys, F.concat(F.coalesce(F.array_join(gaps, ""), F.lit("")), tail).alias("seq"))


def _lines_of_runs(runs: DataFrame, n_sites: int, keys: list[str], dash: str) -> DataFrame:
    """The lines of :func:`alignment_lines`; where runs overlap, all cells of the taxon are sorted."""
    run = F.struct("start", "text", "n", "w")
    every = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, run))).alias("_r"))

    def end(a: Column, i: Column) -> Column:
        return F.get(a, i)["start"] + F.get(a, i)["n"]

    def cell(r: Column, j: Column) -> Column:
        return F.struct((r["start"] + j).alias("start"), F.substr(r["text"], j * r["w"] + 1, r["w"]).alias("text"), F.lit(1).alias("n"), r["w"].alias("w"))

    joint = F.transform("_r", lambda r, i: r["start"].isNull() | (F.coalesce(end(F.col("_r"), i - 1), r["start"]) > r["start"]))
    alone = F.array_sort(F.flatten(F.transform("_r", lambda r: F.transform(F.sequence(F.lit(0), r["n"] - 1), lambda j: cell(r, j)))))
    sorted_ = every.withColumn("_r", F.when(F.exists(joint, lambda x: x), alone).otherwise(F.col("_r")))
    # a null key never met itself in a join: such a row stays empty
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    placed = sorted_.withColumn("_r", F.when(whole, F.col("_r")))
    gaps = F.transform("_r", lambda r, i: F.concat(F.repeat(F.lit(dash), r["start"] - F.when(i == 0, 0).otherwise(end(F.col("_r"), i - 1))), r["text"]))
    tail = F.repeat(F.lit(dash), F.lit(n_sites) - F.coalesce(end(F.col("_r"), F.size("_r") - 1), F.lit(0)))
    return placed.select(*keys, F.concat(F.coalesce(F.array_join(gaps, ""), F.lit("")), tail).alias("seq"))


def phylip_lines(cells: DataFrame, n_sites: int, width: int = 1) -> DataFrame:
    """Lines (_part, taxon, value) of a padded PHYLIP text: the header with the sizes in part 0, a line per taxon in part 1."""
    lines = alignment_lines(cells, n_sites, width=width).withColumn("taxon", F.col("taxon").cast("string"))
    size = lines.agg(F.max(F.length("taxon")).alias("w"), F.count(F.lit(1)).alias("n"))
    pad = size.select("w").scalar()
    body = lines.select(F.lit(1).alias("_part"), "taxon", F.concat(F.rpad("taxon", pad + 2, " "), "seq").alias("value"))
    head = size.select(F.lit(0).alias("_part"), F.lit("").alias("taxon"), F.concat_ws(" ", "n", F.lit(n_sites * width)).alias("value"))
    return head.unionByName(body)


def write_phylip(cells: DataFrame, path: str, n_sites: int, width: int = 1) -> None:
    """Padded PHYLIP text, header first; ``width`` 3 writes codons, whose header counts letters."""
    phylip_lines(cells, n_sites, width).orderBy("_part", "taxon").select("value").write.mode("overwrite").text(path)


def fasta_lines(cells: DataFrame, n_sites: int) -> DataFrame:
    """One value per taxon: its name behind '>', and its row on the next line."""
    text = F.concat(F.lit(">"), F.col("taxon").cast("string"), F.lit("\n"), "seq")
    return alignment_lines(cells, n_sites).select(text.alias("value"))


def write_fasta(cells: DataFrame, path: str, n_sites: int) -> None:
    fasta_lines(cells, n_sites).write.mode("overwrite").text(path)


def wide_table(df: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Long posterior table to the wide layout: one row per ``row``, one column per name."""
    return df.groupBy(row).pivot(column, names).agg(F.first(value))


def write_table(df: DataFrame, path: str, layout: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a posterior table as Parquet (default) or as tab-separated text with a header."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if layout == "tab":
        writer.csv(path, sep="\t", header=True)
    elif layout == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown layout {layout}")
