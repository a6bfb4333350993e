"""Tree samples: node tables, splits of every tree, and edits of whole lists.

``trees(run, iter, newick)`` is parsed tree by tree inside ``mapInPandas``, so the
list never shuffles. Node tables of a single tree are handled level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions import newick as nw
from cladeframe.operators.clades import Clades
from cladeframe.session import durable

NODE_COLUMNS = (
    "node int, parent int, taxon string, length double, support double, depth int, child_ix int, last_node int"
)
# Levels planned in one piece before the lineage is cut.
LEVELS_PER_CUT = 6


def _run_type(trees: DataFrame) -> str:
    return trees.schema["run"].dataType.simpleString()


def tree_nodes(trees: DataFrame) -> DataFrame:
    """Node table of every tree; nodes are numbered in preorder, ``last_node`` ends the subtree."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):  # a bounded number of nodes at a time
                yield _node_rows(batch.slice(a, 1024))

    return trees.select("run", F.col("iter").cast("bigint").alias("iter"), "newick").mapInArrow(
        explode, f"run {_run_type(trees)}, iter bigint, {NODE_COLUMNS}"
    )


def _node_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    owner: list[int] = []
    number: list[int] = []
    parent: list[int | None] = []
    nodes: list[nw.Node] = []
    depth: list[int] = []
    place: list[int] = []
    last: list[int] = []
    for row, text in enumerate(batch.column("newick").to_pylist()):
        listed, up, depths = nw.preorder(nw.parse(text))
        n = len(listed)
        seen, places, ends = [0] * n, [0] * n, list(range(n))
        for i in range(1, n):
            places[i] = seen[up[i]]
            seen[up[i]] += 1
        for i in range(n - 1, 0, -1):
            if ends[i] > ends[up[i]]:
                ends[up[i]] = ends[i]
        owner += [row] * n
        number += range(n)
        parent.append(None)
        parent += up[1:]
        nodes += listed
        depth += depths
        place += places
        last += ends
    rows = pa.array(owner, pa.int64())
    whole = [pa.array(x, pa.int32()) for x in (number, parent, depth, place, last)]
    taxon = pa.array([x.taxon for x in nodes], pa.string())
    length, support = (pa.array([getattr(x, c) for x in nodes], pa.float64(), from_pandas=True) for c in ("length", "support"))
    columns = [batch.column("run").take(rows), batch.column("iter").take(rows), *whole[:2], taxon, length, support, *whole[2:]]
    return pa.RecordBatch.from_arrays(columns, ["run", "iter", *[c.split()[0] for c in NODE_COLUMNS.split(", ")]])


def tree_splits(trees: DataFrame, with_support: bool = False, rooted: bool = False, count_trees: bool = False) -> DataFrame:
    """Splits of every tree with their taxa, leaves included: (run, iter, split, length).

    The unrooted tree is used unless ``rooted``. A split is oriented away from the
    first taxon of its tree, and the two branches at a root with two children are one
    split with the summed length. ``with_support`` returns the support as ``weight``;
    ``count_trees`` adds one empty split per tree.
    Lists that are only counted need no taxa in every row: see :mod:`clades`.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 256):  # a bounded number of member lists at a time
                rows: list[tuple] = []
                part = pdf.iloc[a : a + 256]
                for run, it, text in zip(part["run"], part["iter"], part["newick"], strict=True):
                    clades = Clades(text)
                    if count_trees:
                        rows.append((run, it, [], 0.0, None))
                    for side, (_, length, support, node) in clades.branches(rooted).items():
                        rows.append((run, it, clades.members(node, clades.side[node] != side), length, support))
                yield pd.DataFrame(rows, columns=["run", "iter", "split", "length", "weight"]).astype({"weight": "float64"})

    out = trees.select("run", "iter", "newick").mapInPandas(
        explode, f"run {_run_type(trees)}, iter bigint, split array<string>, length double, weight double"
    )
    return out if with_support else out.drop("weight")


def tree_taxa(trees: DataFrame) -> DataFrame:
    """Distinct (run, taxon) of a tree list."""
    return tree_nodes(trees).filter(F.col("taxon").isNotNull()).select("run", "taxon").distinct()


def rewrite_trees(trees: DataFrame, edit: Callable[[nw.Node], nw.Node | None]) -> DataFrame:
    """Apply an edit to every tree of the list; a tree that becomes empty is dropped."""

    def run_edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            edited = [edit(nw.parse(t)) for t in pdf["newick"]]
            pdf = pdf.assign(newick=[None if r is None else nw.render(r) for r in edited])
            yield pdf[pdf["newick"].notna()]

    return trees.select("run", "iter", "newick").mapInPandas(run_edit, f"run {_run_type(trees)}, iter bigint, newick string")


def unroot(trees: DataFrame) -> DataFrame:
    return rewrite_trees(trees, nw.unroot)


def reroot(trees: DataFrame, outgroup: list[str]) -> DataFrame:
    """Trees rooted above the outgroup; ``rooted`` is false where it is no clade and the tree stays unrooted."""
    group = set(outgroup)

    @F.pandas_udf("newick string, rooted boolean")
    def edited(texts: pd.Series) -> pd.DataFrame:
        made = [nw.reroot(nw.parse(t), group) for t in texts]
        return pd.DataFrame({"newick": [nw.render(r) for r, _ in made], "rooted": [ok for _, ok in made]})

    return trees.select("run", "iter", edited("newick").alias("_e")).select("run", "iter", "_e.newick", "_e.rooted")


def prune_taxa(trees: DataFrame, keep: list[str]) -> DataFrame:
    kept = set(keep)
    return rewrite_trees(trees, lambda root: nw.prune(root, kept))


def tree_stats(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per tree: leaves, nodes, total length, and height in edges."""
    return nodes.groupBy(*keys).agg(
        F.count("taxon").alias("n_leaves"),
        F.count(F.lit(1)).alias("n_nodes"),
        F.sum(F.when(F.col("depth") > 0, F.coalesce("length", F.lit(0.0))).otherwise(0.0)).alias("length"),
        F.max("depth").alias("height"),
    )


def tree_length(branch_len: DataFrame, factor: float = 1.0) -> DataFrame:
    """Total branch length per draw times a normalisation factor."""
    return branch_len.groupBy("run", "iter").agg((F.sum("length") * F.lit(factor)).alias("tree_length"))


def max_depth(nodes: DataFrame) -> int:
    return int(nodes.agg(F.max("depth")).first()[0] or 0)


def fold_up(
    nodes: DataFrame, keys: list[str], start: dict[str, Column], merge: Callable[[], list[Column]], finish: dict[str, Column] | None = None
) -> DataFrame:
    """Values of all nodes from the leaves to the root, one aggregation per level.

    ``start`` gives the leaf values; ``merge`` lists aggregates over the children with
    the same names; ``finish`` rewrites them on the parent's row. The lineage is cut
    every few levels.
    """
    names = list(start)
    leaf = nodes.filter(F.col("taxon").isNotNull()).select("*", *[c.alias(n) for n, c in start.items()])
    inner = nodes.filter(F.col("taxon").isNull())
    depth = max_depth(nodes)
    level = leaf.filter(F.col("depth") == depth)
    done = level
    for d in range(depth - 1, -1, -1):
        merged = level.groupBy(*keys, F.col("parent").alias("node")).agg(*[m.alias(n) for n, m in zip(names, merge(), strict=True)])
        up = inner.filter(F.col("depth") == d).join(merged, [*keys, "node"])
        for n, c in (finish or {}).items():
            up = up.withColumn(n, c)
        level = up.unionByName(leaf.filter(F.col("depth") == d))
        if (depth - d) % LEVELS_PER_CUT == 0:
            level = durable(level)
        done = done.unionByName(level)
    return done


def node_depths(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per node: height in edges, largest root-ward length depth and number of leaves below."""
    own = F.coalesce("length", F.lit(0.0))
    return fold_up(
        nodes, keys,
        {"height": F.lit(0), "path": own, "size": F.lit(1).cast("bigint")},
        lambda: [F.max("height") + 1, F.max("path"), F.sum("size")],
        {"path": F.col("path") + own},
    )


def mrca_labels(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Leftmost and rightmost leaf of every node, children in ``child_ix`` order."""
    return fold_up(
        nodes, keys, {"leftmost": F.col("taxon"), "rightmost": F.col("taxon")},
        lambda: [F.min_by("leftmost", "child_ix"), F.max_by("rightmost", "child_ix")],
    )


def to_newick(nodes: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Newick text per tree, built from the leaves up; children sort by their first leaf name."""

    def size(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.format_string(f":%.{digits}f", F.col(c))).otherwise("")

    mark = F.lit("")
    if "support" in nodes.columns:
        mark = F.when(F.col("support").isNotNull(), F.format_string("%.2f", F.col("support"))).otherwise("")
    built = fold_up(
        nodes, keys, {"first_leaf": F.col("taxon"), "text": F.concat(F.col("taxon"), size("length"))},
        lambda: [F.min("first_leaf"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_leaf", "text"))), lambda x: x["text"]), ",")],
        {"text": F.concat(F.lit("("), F.col("text"), F.lit(")"), mark, F.when(F.col("parent").isNotNull(), size("length")).otherwise(""))},
    )
    return built.filter(F.col("parent").isNull()).select(*keys, F.concat(F.col("text"), F.lit(";")).alias("newick"))


def with_depth(nodes: DataFrame) -> DataFrame:
    """Add ``depth`` to a node table that has only parent links, level by level."""
    level = nodes.filter(F.col("parent").isNull()).withColumn("depth", F.lit(0))
    done, d = level, 0
    while True:
        d += 1
        level = durable(nodes.join(level.select(F.col("node").alias("parent")), "parent").select(*nodes.columns, F.lit(d).alias("depth")))
        if level.isEmpty():
            return done
        done = done.unionByName(level)


def register_tree(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Match the leaves of one tree with the data taxa and prune leaves without data.

    Data taxa that the tree lacks raise. Nodes left with one child are joined with it
    and the lengths are added.
    """
    names = taxa.select(F.col("taxon").cast("string").alias("taxon")).distinct()
    lost = names.join(nodes.select("taxon"), "taxon", "left_anti").agg(F.min("taxon")).scalar()
    checked = names.filter(F.when(lost.isNotNull(), F.raise_error(F.concat(F.lit("taxon not in the tree: "), lost))).otherwise(F.lit(True)).cast("boolean"))
    return prune_nodes(nodes, checked)


def prune_nodes(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """Prune a node table (node, parent, taxon, length, depth) to the leaves in ``keep``."""
    marked = nodes.join(keep.select("taxon", F.lit(1).alias("_keep")), "taxon", "left")
    alive = fold_up(
        marked, [], {"_alive": F.coalesce("_keep", F.lit(0)), "_kids": F.lit(0)},
        lambda: [F.max("_alive"), F.sum("_alive").cast("int")],
    ).filter(F.col("_alive") == 1)
    # read once by every level below
    alive = durable(alive.withColumn("_unary", F.col("taxon").isNull() & (F.col("_kids") == 1)).select(*nodes.columns, "_unary"))
    level = alive.filter(F.col("parent").isNull()).withColumn("_to", F.lit(None).cast("string")).withColumn("_len", F.lit(0.0))
    done = level
    for d in range(1, max_depth(nodes) + 1):
        above = level.select(F.col("node").alias("parent"), F.col("_unary").alias("_pu"), F.col("_to").alias("_pt"), F.col("_len").alias("_pl"))
        step = F.coalesce("length", F.lit(0.0))
        level = (
            alive.filter(F.col("depth") == d).join(above, "parent")
            .withColumn("_to", F.when(F.col("_pu"), F.col("_pt")).otherwise(F.col("parent").cast("string")))
            .withColumn("_len", F.when(F.col("_pu"), F.col("_pl") + step).otherwise(step))
            .select(*alive.columns, "_to", "_len")
        )
        if d % LEVELS_PER_CUT == 0:
            level = durable(level)
        done = done.unionByName(level)
    return done.filter(~F.col("_unary")).select(
        F.col("node").cast("string").alias("node"), F.col("_to").alias("parent"), "taxon",
        F.when(F.col("_to").isNotNull(), F.col("_len")).alias("length"),
    )


def missing_map(cells: DataFrame, nodes: DataFrame, n_sites: int | None = None) -> DataFrame:
    """State of every (branch, site): 1 informative, 2 root of the observed subtree; 0 rows are left out.

    Observed leaves pass up; a node counts its children with data. Going down, a node
    with data below a marked branch is 1, and the topmost branching one is 2.
    """
    seen = cells.filter(F.col("state").isNotNull()).select(F.col("taxon").cast("string").alias("taxon"), "site").distinct()
    depth = max_depth(nodes)
    base = nodes.select(F.col("node").alias("node"), "parent", "taxon", "depth")
    leaf = base.filter(F.col("taxon").isNotNull()).join(seen, "taxon").select("node", "parent", "depth", "site", F.lit(1).alias("_c"), F.lit(True).alias("_leaf"))
    level = leaf.filter(F.col("depth") == depth)
    counted = level
    for d in range(depth - 1, -1, -1):
        counts = level.groupBy(F.col("parent").alias("node"), "site").agg(F.count(F.lit(1)).cast("int").alias("_c"))
        up = base.filter((F.col("depth") == d) & F.col("taxon").isNull()).join(counts, "node").select("node", "parent", "depth", "site", "_c", F.lit(False).alias("_leaf"))
        level = up.unionByName(leaf.filter(F.col("depth") == d))
        if (depth - d) % LEVELS_PER_CUT == 0:
            level = durable(level)
        counted = counted.unionByName(level)
    # read once by every level of the way down
    counted = durable(counted)
    level = counted.filter(F.col("depth") == 0).withColumn("mark", F.when(F.col("_c") > 1, 2).otherwise(0))
    done = level
    for d in range(1, depth + 1):
        above = level.select(F.col("node").alias("parent"), "site", F.col("mark").alias("_up"))
        mark = F.when(F.col("_up") > 0, 1).when(F.col("_leaf") | (F.col("_c") > 1), 2).otherwise(0)
        level = counted.filter(F.col("depth") == d).join(above, ["parent", "site"]).withColumn("mark", mark).drop("_up")
        if d % LEVELS_PER_CUT == 0:
            level = durable(level)
        done = done.unionByName(level)
    return done.filter(F.col("mark") > 0).select("node", "site", "mark")
