"""Codon alignments, translation and codon-space tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.alphabets import DNA, codon_rows, genetic_code, is_stop, translation
from cladeframe.functions.moments import shares, squared_distance
from cladeframe.operators.alignment import observed, select_sites, site_summary, state_counts
from cladeframe.operators.composition import distances_from_counts


def _codon(p1: Column, p2: Column, p3: Column, code: str) -> Column:
    """Three bases to a codon; null when one is missing or the codon is a stop."""
    return F.when(~is_stop(p1, p2, p3, code), F.concat(p1, p2, p3))


def codons(cells: DataFrame, code: str = "universal", n_sites: int | None = None) -> DataFrame:
    """Nucleotide cells to codon cells, one row per (taxon, floor(site / 3))."""
    if n_sites is not None and n_sites % 3:
        raise ValueError(f"{n_sites} sites is not a multiple of 3")
    place = F.col("site") % 3
    # the codes of letters, not the letters: numbers are aggregated by hash, text would be sorted
    letter = F.when((F.length("state") == 1) & (F.ascii("state") < 128), F.ascii("state"))
    wrong = F.raise_error(F.concat(F.lit("not a letter of an alignment: "), F.col("state"))).cast("int")
    number = F.when(F.col("state").isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(letter, wrong))
    bases = [F.max(F.when(place == i, number)).alias(f"_p{i + 1}") for i in range(3)]
    return (
        cells.groupBy("taxon", F.floor(F.col("site") / 3).cast("int").alias("site"))
        .agg(*bases)
        .select("taxon", "site", _codon(*[F.char(f"_p{i}") for i in (1, 2, 3)], code).alias("state"))
    )


def triples_of_rows(seqs: DataFrame) -> DataFrame:
    """Wide sequences (taxon, seq ARRAY<STRING>) cut into triples (taxon, site, p1, p2, p3) without a shuffle."""
    # no filter: it would run below a shuffle of the rows, on a value that is made above it, and make it twice
    places = F.when(F.size("seq") > 0, F.sequence(F.lit(0), F.ceil(F.size("seq") / 3).cast("int") - 1))
    cut = seqs.select("taxon", "seq", F.explode(places).alias("site"))
    return cut.select("taxon", "site", *[F.get("seq", F.col("site") * 3 + k).alias(f"p{k + 1}") for k in range(3)])


def codons_of_rows(seqs: DataFrame, code: str = "universal") -> DataFrame:
    """Wide sequences to codon cells without a shuffle."""
    return triples_of_rows(seqs).select("taxon", "site", _codon(F.col("p1"), F.col("p2"), F.col("p3"), code).alias("state"))


def codons_of_text(texts: DataFrame, code: str = "universal") -> DataFrame:
    """Sequences as plain text (taxon, text) to codon cells: cut in threes, and only sense codons are states.

    The fastest form: one regular-expression pass per row and a hash lookup per codon.
    """
    sense = [r[1] for r in codon_rows(code) if not r[6]]
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,3}"), F.lit(0))
    cells = texts.select("taxon", F.posexplode(pieces).alias("site", "triple"))
    return cells.select("taxon", "site", "triple", F.when(F.col("triple").isin(sense), F.col("triple")).alias("state"))


def translate(codon_cells: DataFrame, code: str = "universal") -> DataFrame:
    return codon_cells.withColumn("state", translation(F.col("state"), code))


def drop_aa_constant_sites(codon_cells: DataFrame, code: str = "universal") -> DataFrame:
    """Delete codon columns whose translated state does not vary."""
    # codes of the letters: numbers are aggregated by hash, text would be sorted
    acids = translate(codon_cells, code).select("site", F.ascii("state").alias("state"))
    varying = site_summary(acids).filter(F.col("min_state") != F.col("max_state"))
    return select_sites(codon_cells, varying)


def aa_constant_site_counts(codon_cells: DataFrame, code: str = "universal") -> DataFrame:
    per_site = site_summary(translate(codon_cells, code))
    return per_site.agg(
        F.count(F.when(F.col("min_state") == F.col("max_state"), 1)).alias("eliminated"),
        F.count(F.when(F.col("n_obs") == 0, 1)).alias("all_missing"),
        F.count(F.when(F.col("min_state") != F.col("max_state"), 1)).alias("kept"),
    )


def position_counts(codon_cells: DataFrame, groups: dict[str, list[int]]) -> DataFrame:
    """Nucleotide counts per taxon for each named group of codon positions (1..3)."""
    aggs, names = [], {}
    for name, places in groups.items():
        names[name] = []
        for base in DNA:
            parts = [F.count(F.when(F.substring("state", p, 1) == base, 1)) for p in places]
            col = f"_{name}_{base}"
            aggs.append(sum(parts[1:], parts[0]).alias(col))
            names[name].append(col)
    return observed(codon_cells).groupBy("taxon").agg(*aggs).select(
        "taxon", *[F.array(*cols).alias(name) for name, cols in names.items()]
    )


def nuc_heterogeneity(codon_cells: DataFrame, pos: int | None = None) -> DataFrame:
    """Per taxon distance of the nucleotide composition from the pooled one (all or one position)."""
    counts = position_counts(codon_cells, {"counts": [pos] if pos else [1, 2, 3]})
    return distances_from_counts(counts, len(DNA), True, []).select("taxon", "dist")


def nuc123_heterogeneity(codon_cells: DataFrame) -> DataFrame:
    """Per taxon squared distance between positions 1+2 and position 3."""
    counts = position_counts(codon_cells, {"first_two": [1, 2], "third": [3]})
    return counts.select("taxon", squared_distance(shares(F.col("first_two")), shares(F.col("third"))).alias("dist"))


def aa_heterogeneity(codon_cells: DataFrame, acids: list[str], code: str = "universal") -> DataFrame:
    counts = state_counts(observed(translate(codon_cells, code)), ["taxon"], acids)
    return distances_from_counts(counts, len(acids), True, []).select("taxon", "dist")


def codon_diversity(codon_cells: DataFrame, acids: list[str], code: str = "universal") -> DataFrame:
    """Sum over sites of the number of distinct amino acids."""
    counts = state_counts(observed(translate(codon_cells, code)), ["site"], acids)
    return counts.agg(F.sum(F.size(F.filter("counts", lambda c: c > 0))).cast("bigint").alias("diversity"))


def codon_neighbours(codes: DataFrame) -> DataFrame:
    """Ordered pairs of sense codons that differ at exactly one position.

    The other two positions are the join key, one equi-join per position.
    """
    sense = codes.filter(~F.col("is_stop"))
    steps = []
    for place in (1, 2, 3):
        fixed = [f"p{i}" for i in (1, 2, 3) if i != place]
        a = sense.select(*fixed, F.col("codon").alias("codon_from"), F.col(f"p{place}").alias("nuc_from"), F.col("aa").alias("aa_from"))
        b = sense.select(*fixed, F.col("codon").alias("codon_to"), F.col(f"p{place}").alias("nuc_to"), F.col("aa").alias("aa_to"))
        steps.append(
            a.join(F.broadcast(b), fixed)
            .filter(F.col("nuc_from") != F.col("nuc_to"))
            .select(
                "codon_from", "codon_to", F.lit(place).alias("pos"), "nuc_from", "nuc_to", "aa_from", "aa_to",
                (F.col("aa_from") == F.col("aa_to")).alias("synonymous"),
            )
        )
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


def degeneracy(codes: DataFrame) -> DataFrame:
    """Number of third-position bases that keep the amino acid."""
    sense = codes.filter(~F.col("is_stop"))
    block = sense.groupBy("p1", "p2", "aa").agg(F.count(F.lit(1)).alias("degeneracy"))
    return sense.join(F.broadcast(block), ["p1", "p2", "aa"]).select("codon", "degeneracy")


def non_ct_nearest(codes: DataFrame) -> DataFrame:
    """Per ordered pair of distinct amino acids: -1 without a single-step codon pair, 1 if no such step is C<->T, else 0."""
    steps = codon_neighbours(codes).filter(~F.col("synonymous"))
    ct = F.concat("nuc_from", "nuc_to").isin("CT", "TC")
    near = steps.groupBy("aa_from", "aa_to").agg(F.when(F.bool_or(ct), 0).otherwise(1).alias("non_ct"))
    acids = codes.filter(~F.col("is_stop")).select("aa").distinct()
    left = acids.select(F.col("aa").alias("aa_from"))
    right = F.broadcast(acids.select(F.col("aa").alias("aa_to")))
    pairs = left.join(right, F.col("aa_from") != F.col("aa_to"))
    return pairs.join(near, ["aa_from", "aa_to"], "left").select(
        "aa_from", "aa_to", F.coalesce("non_ct", F.lit(-1)).alias("non_ct")
    )


def with_code(cells: DataFrame, code: str = "universal") -> DataFrame:
    """Codon cells joined with their row of the genetic code (64 rows, broadcast)."""
    codes = genetic_code(cells.sparkSession, code).select(F.col("codon").alias("state"), "p1", "p2", "p3", "aa")
    return cells.join(F.broadcast(codes), "state", "left")

