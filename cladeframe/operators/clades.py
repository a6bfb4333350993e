"""Splits of tree samples by clade hashes.

Every taxon has a 128-bit digest of its name, and a clade the exclusive or of its taxa's.
One pass over a Newick text from the leaves up gives every branch as a row of fixed
width, and the other side of a branch is the digest of all taxa less its own. Counting
is partial in every batch of trees and shuffles one row for each of its distinct splits; a
task writes down the taxa of a split once, not with every tree that has it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[(),;]|[^(),;]+")
_NUMBER = re.compile(r"[-+.\deE]+")
_KEY = ["key1", "key2"]
#: Splits whose taxa a task remembers to have told.
_TOLD = 1_000_000


@lru_cache(maxsize=1 << 16)
def taxon_digest(name: str) -> int:
    """128 bits of a taxon name."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=16).digest(), "little")


class Clades:
    """Nodes of one Newick text in postorder; the root is the last one.

    ``side`` is the digest of the taxa below a node, ``size`` their number, ``first`` and
    ``last`` their range in ``taxa`` (leaves in the order of the text).
    """

    def __init__(self, text: str):
        self.side: list[int] = []
        self.size: list[int] = []
        self.first: list[int] = []
        self.length: list[float | None] = []
        self.support: list[float | None] = []
        self.taxa: list[str] = []
        self.top: list[int] = []  # children of the root
        opened: list[list[int]] = []
        kids: list[int] | None = None  # of the node whose label comes next
        label = ""
        level: list[int] = []
        for token in _TOKEN.findall(text):
            if token == "(":
                opened.append(level)
                level = []
            elif token == "," or token == ")":
                level.append(self._node(label, kids))
                kids, label = None, ""
                if token == ")":
                    if not opened:
                        raise ValueError("unbalanced parentheses in tree")
                    kids, level = level, opened.pop()
            elif token == ";":
                break
            else:
                label = token
        if opened:
            raise ValueError("unbalanced parentheses in tree")
        self.top = kids or []
        self._node(label, kids)
        if len(set(self.taxa)) != len(self.taxa):
            raise ValueError("a taxon stands twice in a tree")

    def _node(self, label: str, kids: list[int] | None) -> int:
        name, _, length = (part.strip() for part in label.partition(":"))
        self.length.append(float(length) if length else None)
        self.support.append(float(name) if kids and name and _NUMBER.fullmatch(name) else None)
        if kids:
            side = 0
            for k in kids:
                side ^= self.side[k]
            self.side.append(side)
            self.size.append(sum(self.size[k] for k in kids))
            self.first.append(self.first[kids[0]])
        else:
            self.first.append(len(self.taxa))
            self.size.append(1 if name else 0)
            self.side.append(taxon_digest(name) if name else 0)
            if name:
                self.taxa.append(name)
        return len(self.side) - 1

    def branches(self, rooted: bool) -> dict[int, list]:
        """Digest of every split to its size, summed length, support and a node that shows it.

        Unless ``rooted``, a split is named by the side without the first taxon; branches
        of the same split (at a root with two children, around nodes with one child) add up.
        """
        every, n = self.side[-1], len(self.taxa)
        order = sorted(range(n), key=self.taxa.__getitem__)
        lead = order[0] if order and not rooted else -1
        out: dict[int, list] = {}
        for node in range(len(self.side) - 1):
            size, side = self.size[node], self.side[node]
            if not size or size == n:
                continue
            if self.first[node] <= lead < self.first[node] + size:
                side, size = every ^ side, n - size
            cell = out.get(side)
            if cell is None:
                out[side] = [size, self.length[node] or 0.0, self.support[node], node]
            else:
                cell[1] += self.length[node] or 0.0
                if cell[2] is None:
                    cell[2] = self.support[node]
        return out

    def members(self, node: int, other: bool = False) -> list[str]:
        """Sorted taxa of a node, or of the other side."""
        a, b = self.first[node], self.first[node] + self.size[node]
        return sorted(self.taxa[:a] + self.taxa[b:] if other else self.taxa[a:b])


def _keys(sides: list[int]) -> np.ndarray:
    """Digests as rows of two longs."""
    return np.frombuffer(b"".join(s.to_bytes(16, "little") for s in sides), "<i8").reshape(-1, 2)


def _run_type(trees: DataFrame) -> str:
    return trees.schema["run"].dataType.simpleString()


def tree_branches(trees: DataFrame, rooted: bool = False) -> DataFrame:
    """Rows (run, iter, key1, key2, size, length, weight): every split of every tree, leaves included.

    ``key1`` and ``key2`` are the digest of the split, ``weight`` its support. The unrooted
    tree is used unless ``rooted``.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 4096):  # a bounded number of branches at a time
                part = batch.iloc[a : a + 4096]
                found = [Clades(t).branches(rooted) for t in part["newick"]]
                counts = [len(f) for f in found]
                keys = _keys([s for f in found for s in f])
                cells = [c for f in found for c in f.values()]
                yield pd.DataFrame({
                    "run": part["run"].repeat(counts).to_numpy(), "iter": part["iter"].repeat(counts).to_numpy(),
                    "key1": keys[:, 0], "key2": keys[:, 1], "size": np.array([c[0] for c in cells], np.int32),
                    "length": np.array([c[1] for c in cells], np.float64), "weight": np.array([c[2] for c in cells], np.float64),
                })

    schema = f"run {_run_type(trees)}, iter bigint, key1 bigint, key2 bigint, size int, length double, weight double"
    made = trees.select("run", "iter", "newick").mapInPandas(explode, schema)
    return made.withColumn("weight", F.when(~F.isnan("weight"), F.col("weight")))


def complete_trees(trees: DataFrame, taxa: list[str]) -> DataFrame:
    """The trees whose leaves are exactly ``taxa``; others can't be compared with them and go."""
    wanted = 0
    for name in set(taxa):
        wanted ^= taxon_digest(name)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[Clades(t).side[-1] == wanted for t in batch["newick"]]]

    return trees.mapInPandas(keep, trees.schema)


def _partial(trees: DataFrame, splits_of) -> DataFrame:
    """(run, key1, key2, n, length, n_supported, weight, split): counts of a batch of trees.

    ``splits_of`` gives the (digest, length, support, node) of a text's splits. The taxa of a
    split come with its first row of a task only.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[int] = set()
        for batch in batches:
            found: dict[tuple, list] = {}
            for run, text in zip(batch["run"], batch["newick"], strict=True):
                clades = Clades(text)
                for side, length, support, node in splits_of(clades):
                    cell = found.get((run, side))
                    if cell is None:
                        cell = found[run, side] = [0, 0.0, 0, 0.0, None]
                        if side not in told:
                            told.add(side)
                            cell[4] = clades.members(node, other=clades.side[node] != side)
                    cell[0] += 1
                    cell[1] += length
                    if support is not None:
                        cell[2] += 1
                        cell[3] += support
            if len(told) > _TOLD:
                told.clear()
            keys = _keys([side for _, side in found])
            columns = list(zip(*found.values(), strict=True)) or [()] * 5
            yield pd.DataFrame({
                "run": [run for run, _ in found], "key1": keys[:, 0], "key2": keys[:, 1], "n": np.array(columns[0], np.int64),
                "length": np.array(columns[1], np.float64), "n_supported": np.array(columns[2], np.int64),
                "weight": np.array(columns[3], np.float64), "split": list(columns[4]),
            })

    schema = f"run {_run_type(trees)}, key1 bigint, key2 bigint, n bigint, length double, n_supported bigint, weight double, split array<string>"
    return trees.select("run", "newick").mapInPandas(count, schema)


def _counted(partial: DataFrame) -> DataFrame:
    """Counts by run and split from those of the batches; digests carry them through the shuffle."""
    counts = partial.groupBy("run", *_KEY).agg(
        F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("mean_length"), F.sum("n_supported").alias("n_supported"),
        (F.sum("weight") / F.nullif(F.sum("n_supported"), F.lit(0))).alias("mean_support"), F.first("split", ignorenulls=True).alias("split"),
    )
    # a split may have its taxa in the rows of another run
    names = counts.filter(F.col("split").isNotNull()).groupBy(*_KEY).agg(F.first("split").alias("split"))
    return counts.drop("split").join(names, _KEY).drop(*_KEY)


def split_counts(trees: DataFrame, rooted: bool = False) -> DataFrame:
    """Per (run, split): trees that have it, mean length over them, trees that support it, mean support over these."""

    def splits_of(clades: Clades) -> Iterator[tuple]:
        return ((side, length, support, node) for side, (_, length, support, node) in clades.branches(rooted).items())

    return _counted(_partial(trees, splits_of))


def tree_split_freq(trees: DataFrame, rooted: bool = False) -> DataFrame:
    """Per (run, split): n, share of the run's trees, mean length, mean support."""
    sizes = trees.groupBy("run").agg(F.count(F.lit(1)).alias("_t"))
    found = split_counts(trees, rooted).join(sizes, "run")
    return found.select("run", "split", "n", (F.col("n") / F.col("_t")).alias("prob"), "mean_length", "mean_support")


def root_split_freq(trees: DataFrame) -> DataFrame:
    """Per (run, root split): share of the run's trees rooted there, and its mean over runs.

    The root split is the first child of the root, straight from the text. Every tree has
    one, so the counts of a run add up to its trees.
    """

    def splits_of(clades: Clades) -> Iterator[tuple]:
        return ((clades.side[c], 0.0, None, c) for c in clades.top[:1])

    counts = _counted(_partial(trees, splits_of))
    n_runs = counts.agg(F.count_distinct("run")).scalar()
    total = F.sum("n").over(Window.partitionBy("run"))
    probs = counts.select("run", "split", "n", (F.col("n") / total).alias("prob"))
    return probs.withColumn("mean_prob", F.sum("prob").over(Window.partitionBy("split")) / n_runs)
