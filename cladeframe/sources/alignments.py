"""Alignment files to cells.

A directory of alignments is read one file per row, and each file is parsed inside
``mapInPandas``; the long cells are exploded by Spark afterwards. A PHYLIP file with
one taxon per line can be of any size and is read line by line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.alphabets import (
    CUSTOM_MISSING,
    DNA,
    NUCLEOTIDE_MISSING,
    PROTEIN,
    PROTEIN_MISSING,
    RNA,
    alphabet_rows,
)

KNOWN = {"dna": (DNA, NUCLEOTIDE_MISSING), "rna": (RNA, NUCLEOTIDE_MISSING), "protein": (PROTEIN, PROTEIN_MISSING)}
# Groups in brackets stand for a polymorphic cell and read as missing.
POLYMORPHIC = re.compile(r"\([^)]*\)|\{[^}]*\}")
SEQS = "aln string, taxon string, seq array<string>"


def _symbols(name: str) -> dict[str, str | None]:
    return {r[1]: r[2] for r in alphabet_rows(name, *KNOWN[name])}


def _infer(rows: list[tuple[str, str]]) -> dict[str, str | None]:
    """The first of DNA, RNA and protein whose letters cover the data."""
    letters = set().union(*[set(s) for _, s in rows])
    for name in KNOWN:
        table = _symbols(name)
        if letters <= table.keys():
            return table
    raise ValueError(f"no alphabet has all of {''.join(sorted(letters))}")


def _translate(rows: list[tuple[str, str]], table: dict, n_sites: int | None = None) -> list[tuple[str, list]]:
    names = [n for n, _ in rows]
    if len(set(names)) < len(names):
        raise ValueError("taxon found twice")
    out = []
    for name, seq in rows:
        bad = set(seq) - table.keys()
        if bad:
            raise ValueError(f"taxon {name}: unknown letters {''.join(sorted(bad))}")
        states = [table[c] for c in seq]
        if n_sites is not None:
            states += [None] * (n_sites - len(states))
        out.append((name, states))
    return out


def _sequential(body: str, n_taxa: int, n_sites: int) -> list[tuple[str, str]] | None:
    """Name, then letters over any number of lines; None when the sizes do not fit."""
    tokens = iter(body.split())
    rows = []
    for name in tokens:
        seq = ""
        while len(seq) < n_sites:
            part = next(tokens, None)
            if part is None:
                return None
            seq += part
        if len(seq) > n_sites:
            return None
        rows.append((name, seq))
    return rows if len(rows) == n_taxa and len({n for n, _ in rows}) == n_taxa else None


def _interleaved(body: str, n_taxa: int, n_sites: int) -> list[tuple[str, str]]:
    """Blocks of one line per taxon; later blocks may repeat the names."""
    lines = [ln.split() for ln in body.splitlines() if ln.strip()]
    names = [ln[0] for ln in lines[:n_taxa]]
    seqs = [""] * n_taxa
    for i, words in enumerate(lines):
        k = i % n_taxa
        seqs[k] += "".join(words[1:] if words[0] == names[k] else words)
    if len(lines) % n_taxa or any(len(s) != n_sites for s in seqs):
        raise ValueError("sizes do not match the header")
    return list(zip(names, seqs, strict=True))


def parse_phylip(text: str, fmt: str = "phylip") -> list[tuple[str, list]]:
    head, _, body = text.strip().partition("\n")
    n_taxa, n_sites = (int(x) for x in head.split()[:2])
    for form in (_sequential, _interleaved) if fmt != "interleaved" else (_interleaved,):
        rows = form(body, n_taxa, n_sites)
        if rows is None:
            continue
        try:
            return _translate(rows, _infer(rows))
        except ValueError:
            if form is _interleaved or fmt == "sequential":
                raise
    raise ValueError("not a PHYLIP alignment")


def parse_nexus(text: str) -> list[tuple[str, list]]:
    """Matrix of a NEXUS file; comments in square brackets go, short rows are filled up as missing."""
    text = re.sub(r"\[[^\]]*\]", "", text)
    sizes = re.search(r"dimensions[^;]*?=\s*(\d+)[^;]*?=\s*(\d+)", text, re.I)
    kind = re.search(r"datatype\s*=\s*(\w+)", text, re.I)
    matrix = re.search(r"matrix(.*?);", text, re.I | re.S)
    if not (sizes and kind and matrix) or kind.group(1).lower() not in KNOWN:
        raise ValueError("not a NEXUS alignment")
    n_taxa, n_sites = int(sizes.group(1)), int(sizes.group(2))
    rows: dict[str, str] = {}
    for line in matrix.group(1).splitlines():
        if line.strip():
            name, _, rest = line.strip().partition(" ") if " " in line.strip() else line.strip().partition("\t")
            rows[name] = rows.get(name, "") + POLYMORPHIC.sub("?", "".join(rest.split()))
    if len(rows) != n_taxa:
        raise ValueError(f"found {len(rows)} taxa instead of {n_taxa}")
    return _translate(list(rows.items()), _symbols(kind.group(1).lower()), n_sites)


def parse_custom(text: str) -> list[tuple[str, list]]:
    """Own alphabet in the header; unknown letters are an error."""
    head, _, body = text.strip().partition("\n")
    words = head.split()[1:]
    while len(words) < 3:
        head, _, body = body.strip().partition("\n")
        words += head.split()
    n_taxa, n_sites, letters = int(words[0]), int(words[1]), words[2]
    rows = _sequential(POLYMORPHIC.sub("?", body), n_taxa, n_sites)
    if rows is None:
        raise ValueError("sizes do not match the header")
    table: dict[str, str | None] = dict.fromkeys(CUSTOM_MISSING)
    table.update({c: c for c in letters})
    return _translate(rows, table)


def parse(text: str, fmt: str = "auto") -> list[tuple[str, list]]:
    first = text.split(None, 1)[0] if text.strip() else ""
    if fmt == "nexus" or (fmt == "auto" and first.upper() == "#NEXUS"):
        return parse_nexus(text)
    if fmt == "custom" or (fmt == "auto" and first == "#SPECIALALPHABET"):
        return parse_custom(text)
    return parse_phylip(text, fmt)


def read_alignments(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """Wide rows (aln, taxon, seq) of all files under ``path``; ``aln`` is the file name.

    ``fmt``: auto, nexus, custom, phylip, sequential or interleaved.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for aln, text in zip(pdf["aln"], pdf["value"], strict=True):
                rows = parse(text, fmt)
                yield pd.DataFrame({"aln": aln, "taxon": [n for n, _ in rows], "seq": [s for _, s in rows]})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("aln"), "value")
    return files.mapInPandas(read, SEQS)


def read_phylip_lines(spark: SparkSession, path: str, alphabet: str) -> DataFrame:
    """PHYLIP with one taxon per line, split by lines and encoded with built-ins only."""
    table = _symbols(alphabet)
    known = F.create_map(*[F.lit(x) for pair in ((k, v or "") for k, v in table.items()) for x in pair])
    words = F.split(F.trim("value"), r"\s+", 2)
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("aln"), words.alias("w"))
    is_row = (F.size("w") == 2) & ~F.get(F.col("w"), 1).rlike(r"^\d+$")
    letters = F.split(F.regexp_replace(F.get(F.col("w"), 1), r"\s", ""), "")

    def state(c: Column) -> Column:
        return F.when(known[c].isNull(), F.raise_error(F.lit("unknown letter")).cast("string")).otherwise(F.nullif(known[c], F.lit("")))

    # the header is guarded in the expression too, as a pushed filter may look at seq first
    seq = F.when(is_row, F.transform(letters, state))
    return lines.filter(is_row).select("aln", F.col("w")[0].alias("taxon"), seq.alias("seq"))


def to_cells(seqs: DataFrame) -> DataFrame:
    """Wide rows to cells(aln, taxon, site, state)."""
    return seqs.select("aln", "taxon", F.posexplode("seq").alias("site", "state"))


def convert_alignments(spark: SparkSession, source: str, target: str, fmt: str = "auto", to: str = "phylip") -> None:
    """Convert all files under ``source``; the output has one folder part per alignment.

    Wide rows keep whole sequences, so nothing is regrouped by site.
    """
    seqs = read_alignments(spark, source, fmt)
    text = F.array_join(F.transform("seq", lambda s: F.coalesce(s, F.lit("-"))), "")
    body = seqs.select("aln", "taxon", text.alias("seq"))
    if to == "fasta":
        lines = body.select("aln", F.concat(F.lit(">"), "taxon", F.lit("\n"), "seq").alias("value"))
        lines.repartition("aln").write.mode("overwrite").partitionBy("aln").text(target)
        return
    sizes = body.groupBy("aln").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("s"), F.max(F.length("taxon")).alias("w"))
    head = sizes.select("aln", F.lit("").alias("taxon"), F.concat_ws(" ", "n", "s").alias("value"))
    rows = body.join(sizes, "aln").select("aln", "taxon", F.concat(F.rpad("taxon", F.col("w") + 2, F.lit(" ")), "seq").alias("value"))
    both = head.unionByName(rows).repartition("aln").sortWithinPartitions("aln", "taxon")
    both.select("aln", "value").write.mode("overwrite").partitionBy("aln").text(target)
