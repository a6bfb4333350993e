"""State spaces: symbols, genetic codes and amino-acid groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The states and the letters that read as missing.
PROTEIN = list("ACDEFGHIKLMNPQRSTVWY")
DNA = list("ACGT")
RNA = list("ACGU")
PROTEIN_MISSING = list("-?$.BZ*Xx")
NUCLEOTIDE_MISSING = list("BDHKMNRSVWYbdhkmnrsvwy-?$.*Xx")
CUSTOM_MISSING = list("?-*Xx")

# Codons run over TCAG at each position, third position fastest;
# one amino acid per codon, '*' for a stop.
CODON_BASES = "TCAG"
GENETIC_CODES = {
    "universal": "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "mtmam": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    "mtinv": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
}

# Amino-acid groups of the two recodings; a letter in no group is missing.
RECODINGS = {
    "dayhoff6": ["ILMV", "HKR", "DENQ", "AGPST", "FWY", "C"],
    "dayhoff4": ["FILMV", "HKR", "DENQWY", "AGPST"],
}


def alphabet_rows(name: str, states: list[str], missing: list[str]) -> list[tuple]:
    """(alphabet, symbol, state, state_ix): both cases of a state, then the missing letters."""
    rows: dict[str, tuple] = {}
    for ix, state in enumerate(states):
        for symbol in dict.fromkeys([state, state.upper(), state.lower()]):
            rows.setdefault(symbol, (name, symbol, state, ix))
    for symbol in missing:
        rows.setdefault(symbol, (name, symbol, None, None))
    return list(rows.values())


def alphabet(spark: SparkSession, name: str, states: list[str] | None = None, missing: list[str] | None = None) -> DataFrame:
    """Symbol dimension for ``protein``, ``dna``, ``rna`` or a custom list of states."""
    known = {"protein": (PROTEIN, PROTEIN_MISSING), "dna": (DNA, NUCLEOTIDE_MISSING), "rna": (RNA, NUCLEOTIDE_MISSING)}
    base, absent = known.get(name, (states, CUSTOM_MISSING))
    rows = alphabet_rows(name, states or base, missing or absent)
    return spark.createDataFrame(rows, "alphabet string, symbol string, state string, state_ix int")


def codon_rows(code: str) -> list[tuple]:
    acids = GENETIC_CODES[code]
    codons = [a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES]
    return [
        (code, c, c[0], c[1], c[2], None if aa == "*" else aa, aa == "*")
        for c, aa in zip(codons, acids, strict=True)
    ]


def genetic_code(spark: SparkSession, code: str = "universal") -> DataFrame:
    """64 rows: codon, its three bases, amino acid (null for a stop)."""
    return spark.createDataFrame(
        codon_rows(code),
        "code string, codon string, p1 string, p2 string, p3 string, aa string, is_stop boolean",
    )


def sense_codons(code: str = "universal") -> list[str]:
    return [r[1] for r in codon_rows(code) if not r[6]]


def translation(codon: Column, code: str = "universal") -> Column:
    """Amino acid of a codon column, null for stops and anything unknown."""
    pairs = [F.lit(v) for r in codon_rows(code) if not r[6] for v in (r[1], r[5])]
    return F.create_map(*pairs)[codon]


def is_stop(p1: Column, p2: Column, p3: Column, code: str = "universal") -> Column:
    """True for a stop codon; false when any position is missing."""
    stops = [r[1] for r in codon_rows(code) if r[6]]
    return F.coalesce(F.concat(p1, p2, p3).isin(stops), F.lit(False))


def recoding(spark: SparkSession, scheme: str) -> DataFrame:
    """(state, recoded): the group of each amino acid, null where it has none."""
    groups = RECODINGS[scheme]
    home = {aa: str(g) for g, members in enumerate(groups) for aa in members}
    return spark.createDataFrame([(aa, home.get(aa)) for aa in PROTEIN], "state string, recoded string")


def pair_index(i: Column, j: Column, n: int) -> Column:
    """Position of the unordered pair (i, j), i != j, in the upper triangle read row by row."""
    lo, hi = F.least(i, j), F.greatest(i, j)
    return (F.floor((F.lit(2 * n) - lo - 1) * lo / 2) + hi - lo - 1).cast("int")


def render_state(state: Column, width: int = 1) -> Column:
    return F.coalesce(state, F.lit("-" * width))
