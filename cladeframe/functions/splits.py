"""Column functions on splits: sorted arrays of the taxa on side 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_split(split: Column, taxa: Column) -> Column:
    """Orient a split so that the first taxon is not in it; ``taxa`` is the sorted taxon array."""
    return F.array_sort(F.when(F.array_contains(split, taxa[0]), F.array_except(taxa, split)).otherwise(split))


def split_or(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def split_and(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def split_not(a: Column, taxa: Column) -> Column:
    return F.array_sort(F.array_except(taxa, a))


def informative(split: Column, n_taxa: Column | int) -> Column:
    """At least two taxa on both sides."""
    n = F.lit(n_taxa) if isinstance(n_taxa, int) else n_taxa
    return (F.size(split) >= 2) & (F.size(split) <= n - 2)


def split_to_string(split: Column, taxa: Column, present: Column | None = None) -> Column:
    """One character per taxon: ``*`` in the split, ``.`` outside, blank when the taxon is absent."""
    here = F.lit(True) if present is None else None

    def mark(t: Column) -> Column:
        shown = here if here is not None else F.array_contains(present, t)
        return F.when(~shown, " ").when(F.array_contains(split, t), "*").otherwise(".")

    return F.array_join(F.transform(taxa, mark), "")


def split_from_string(text: Column, taxa: Column) -> Column:
    """Inverse of :func:`split_to_string` for the taxa on side 1."""
    marks = F.split(text, "")
    hit = F.zip_with(taxa, marks, lambda t, m: F.when(m == "*", t))
    return F.array_sort(F.filter(hit, lambda t: t.isNotNull()))


def smaller_side(split: Column, taxa: Column) -> Column:
    """Taxon list of the smaller side, the split itself on a tie."""
    other = F.array_sort(F.array_except(taxa, split))
    return F.when(F.size(other) < F.size(split), other).otherwise(split)


def _log_double_factorial(top: Column) -> Column:
    """ln of 1 * 3 * ... * top, 0 when top < 1."""
    odds = F.when(top >= 3, F.sequence(F.lit(3), top.cast("int"), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(odds, F.lit(0.0), lambda a, x: a + F.log(x.cast("double")))


def split_prior(size: Column, n: Column) -> Column:
    """Share of unrooted binary trees on n taxa that have a split of sizes (size, n - size)."""
    return F.exp(
        _log_double_factorial(2 * size - 3) + _log_double_factorial(2 * (n - size) - 3) - _log_double_factorial(2 * n - 5)
    )
