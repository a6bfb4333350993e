"""Conflicts between split lists through an index, without comparing all pairs.

Taxa are numbered so that the members of frequent nested clades stand together. A split
then is a bit set packed into longs with its size and its interval of numbers. Two splits
that conflict share a taxon, so their intervals overlap: one of them holds the first
number of the other. Intervals are cut into dyadic cells, a number lies in one dyadic cell
of every width, and an interval holds a number in exactly one of its cells. So the
candidate pairs come from an equi-join on cells, each pair once; sizes and intervals
rule out most nested pairs, and the longs decide.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from cladeframe.session import durable


def taxon_numbers(*lists: DataFrame) -> DataFrame:
    """(taxon, no): taxa of the lists in the order of the nested clades above one half.

    A taxon's place is the sequence of the majority clades that hold it, largest first;
    clades above one half are nested, so each of them gets an unbroken range. The table
    has one row a taxon, like the header of an alignment.
    """
    both = reduce(DataFrame.unionByName, [x.select("split") for x in lists])
    taxa = both.select(F.explode("split").alias("taxon")).distinct()
    scored = [x.select("split", "prob") for x in lists if "prob" in x.columns]
    if scored:
        heavy = reduce(DataFrame.unionByName, scored).filter(F.col("prob") > 0.5).select("split")
        step = F.struct((-F.size("split")).alias("size"), F.xxhash64("split").alias("clade"))
        nested = heavy.select(step.alias("step"), F.explode("split").alias("taxon"))
        paths = nested.groupBy("taxon").agg(F.array_sort(F.collect_set("step")).alias("path"))
        taxa = taxa.join(paths, "taxon", "left")
    else:
        taxa = taxa.withColumn("path", F.lit(None).cast("string"))
    place = Window.partitionBy(F.lit(0)).orderBy(F.col("path").asc_nulls_first(), "taxon")
    return taxa.select("taxon", (F.row_number().over(place) - 1).alias("no"))


@F.pandas_udf(ArrayType(LongType()))
def _packed(numbers: pd.Series) -> pd.Series:
    """Bit sets as longs, as many as the largest number needs."""
    out = []
    for ns in numbers:
        bits = np.zeros((int(max(ns, default=0)) // 64 + 1) * 64, np.uint8)
        bits[np.asarray(ns, np.int64)] = 1
        out.append(np.packbits(bits, bitorder="little").view("<i8").tolist())
    return pd.Series(out)


def indexed(freq: DataFrame, numbers: Column) -> DataFrame:
    """``freq`` with ``_lo``, ``_hi``, ``_size`` and the bit set ``_bits``; empty splits go.

    ``numbers`` is the map from taxon to number.
    """
    told = freq.filter(F.size("split") > 0).withColumn("_map", numbers)
    told = told.withColumn("_n", F.array_sort(F.transform("split", lambda x: F.col("_map")[x])))
    return told.select(
        *freq.columns, F.col("_n")[0].alias("_lo"), F.element_at("_n", -1).alias("_hi"), F.size("_n").alias("_size"), _packed("_n").alias("_bits")
    )


def number_map(numbers: DataFrame) -> Column:
    """The numbering as a map that plans read as one value; it is as long as the longest split can be."""
    return numbers.agg(F.map_from_entries(F.collect_list(F.struct("taxon", "no")))).scalar()


def _down(value: Column, k: Column) -> Column:
    return F.call_function("shiftright", value, k)


def _up(value: Column, k: Column) -> Column:
    return F.call_function("shiftleft", value, k)


def _levels(last: Column) -> Column:
    """Widths (as powers of two) of the dyadic cells up to the one that holds 0 to ``last``."""
    return F.sequence(F.lit(0), F.length(F.bin(last)))


def cells_of_interval(lo: Column, hi: Column) -> Column:
    """The dyadic cells that an interval falls into, as (k, i): the 2^k numbers from i * 2^k.

    Cells that lie inside the interval while the cell of twice the width doesn't; at most
    two of a width, at its ends. ``lo`` and ``hi`` are longs.
    """
    one = F.lit(1).cast("bigint")

    def inside(k: Column, i: Column) -> Column:
        return (_up(i, k) >= lo) & (_up(i + 1, k) <= hi + 1)

    def at(k: Column) -> Column:
        first, last = _down(lo + _up(one, k) - 1, k), _down(hi + 1, k) - 1  # begins inside, ends inside
        own = F.filter(F.array_distinct(F.array(first, last)), lambda i: inside(k, i) & ~inside(k + 1, _down(i, F.lit(1))))
        return F.transform(own, lambda i: F.struct(k.alias("k"), i.alias("i")))

    return F.flatten(F.transform(_levels(hi), at))


def cells_of_number(no: Column, last: Column) -> Column:
    """The dyadic cells that hold a number, one of every width up to that of ``last``."""
    return F.transform(_levels(last), lambda k: F.struct(k.alias("k"), _down(no, k).alias("i")))


def _words_meet(a: Column, b: Column, test) -> Column:
    return F.exists(F.zip_with(a, b, lambda x, y: test(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))), lambda hit: hit)


def _conflicting(a: str, b: str) -> Column:
    """Overlap without containment; nested unbroken intervals are ruled out before the bits are read."""
    def c(side: str, name: str) -> Column:
        return F.col(f"{side}_{name}")

    def holds(x: str, y: str) -> Column:  # an unbroken x around y
        whole = c(x, "hi") - c(x, "lo") + 1 == c(x, "size")
        return whole & (c(x, "lo") <= c(y, "lo")) & (c(y, "hi") <= c(x, "hi"))

    x, y = F.col(f"{a}_bits"), F.col(f"{b}_bits")
    bits = (
        _words_meet(x, y, lambda p, q: p.bitwiseAND(q) != 0)
        & _words_meet(x, y, lambda p, q: p.bitwiseAND(F.bitwise_not(q)) != 0)
        & _words_meet(x, y, lambda p, q: q.bitwiseAND(F.bitwise_not(p)) != 0)
    )
    return ~holds(a, b) & ~holds(b, a) & bits


def index_of(*lists: DataFrame) -> list[DataFrame]:
    """The lists with the columns of the index on a common numbering, written down."""
    held = [durable(x) for x in lists]  # read once for the numbers and once for the index
    numbers = durable(taxon_numbers(*held))
    shared = number_map(numbers)
    last = numbers.agg(F.max("no").cast("bigint")).scalar()
    return [durable(indexed(x, shared).withColumn("_last", last)) for x in held]


_INDEX = ["_lo", "_hi", "_size", "_bits", "_last"]


def _meetings(left: DataFrame, right: DataFrame) -> list[tuple[DataFrame, DataFrame, Column]]:
    """The two ways in which intervals of indexed lists can meet, as (left, right, condition) over a column ``cell``."""
    a = left.withColumnsRenamed({c: f"a{c}" for c in _INDEX})
    b = right.withColumnsRenamed({c: f"b{c}" for c in _INDEX})

    def around(df: DataFrame, side: str) -> DataFrame:
        lo, hi = (F.col(f"{side}_{n}").cast("bigint") for n in ("lo", "hi"))
        return df.withColumn("cell", F.explode(cells_of_interval(lo, hi)))

    def starts(df: DataFrame, side: str) -> DataFrame:
        return df.withColumn("cell", F.explode(cells_of_number(F.col(f"{side}_lo").cast("bigint"), F.col(f"{side}_last"))))

    clash = _conflicting("a", "b")
    return [
        (around(a, "a"), starts(b, "b"), clash),  # b begins inside a, or where a begins
        (starts(a, "a"), around(b, "b"), (F.col("a_lo") > F.col("b_lo")) & clash),  # a begins inside b
    ]


def conflict_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` with (split_b, prob_b) of every split of ``b`` that conflicts with it."""
    left, right = index_of(a, b.groupBy("split").agg(F.max("prob").alias("prob")))
    parts = [
        x.join(y.withColumnsRenamed({"split": "split_b", "prob": "prob_b"}), "cell").filter(clash).select(*a.columns, "split_b", "prob_b")
        for x, y, clash in _meetings(left, right)
    ]
    return reduce(DataFrame.unionByName, parts)


def clashing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct splits of an indexed list that conflict with any split of another; a search ends at its first hit in a task."""
    parts = [
        x.join(y.select(F.col("cell").alias("cell_b"), *[f"b{c}" for c in _INDEX]), (F.col("cell") == F.col("cell_b")) & clash, "left_semi").select("split")
        for x, y, clash in _meetings(left, right)
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def conflicting_splits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct splits of ``a`` that conflict with any split of ``b``."""
    return clashing(*index_of(*[x.select("split", *[c for c in ["prob"] if c in x.columns]) for x in (a, b)]))
