"""Message passing on a tree of any size: likelihood vectors up, everything else down.

Model rows (draw, site, category) are packed into blocks of bounded size, one array a
block. A message is the product of what the subtrees below a node say about every row
and state, kept as sums of logarithms and numbers of zeros, so that products of many
children are sums in any order and one child can be taken out again. One level of the
tree is one join or grouping by (node, block); a node with very many children is summed
in rounds of bounded groups. No step looks at the whole tree.

A tree of up to ``NODES_AT_ONCE`` inner nodes needs no message outside its block: the cells
of a block are read in the order in which the inner nodes are finished, and one task passes
the messages of the block up (and down) in memory. Only cells and model rows are shuffled.
Larger trees go level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.trees import LEVELS_PER_CUT
from cladeframe.session import durable

#: Model rows of a block, sites of a block, draws of a block.
BLOCK_ROWS = 4096
BLOCK_SITES = 256
BLOCK_DRAWS = 64
#: Leaves gathered in one value, messages added up in one step.
LEAVES_AT_ONCE = 256
MESSAGES_AT_ONCE = 16
#: Rows of leaf vectors held at once.
EXPANDED = 1 << 17
#: Inner nodes whose order every task knows; bytes of all messages of a block, where they are kept for the way down.
NODES_AT_ONCE = 1 << 16
KEPT_BYTES = 1 << 28

_FIXED = 5  # site, draw, cat, rate, weight


class Block:
    """The model rows of a block, sorted by site and draw."""

    def __init__(self, blob, k: int):
        width, sites = np.frombuffer(blob, "<i8", 2).tolist()
        rows = np.frombuffer(blob, "<i8", offset=16 + 8 * sites).reshape(-1, width)
        self._times, base = max(1, sites), rows.view("<f8")[:, _FIXED:]
        self._kinds = np.hstack([base[:, k:], base[:, :k]])  # matrices before the rows are repeated
        if sites:  # every row holds for every site
            site = np.frombuffer(blob, "<i8", sites, 16)
            rows = np.hstack([np.repeat(site, len(rows))[:, None], np.tile(rows[:, 1:], (sites, 1))])
        self.site, self.draw, self.cat = (rows[:, i] for i in range(3))
        values = rows.view("<f8")
        self.rate, self.weight = values[:, 3], values[:, 4]
        self.k, self.n = k, len(rows)
        self.pi, self.rr = values[:, _FIXED : _FIXED + k], values[:, _FIXED + k :]
        self._eigen: tuple | None = None

    def eigen(self):
        """One decomposition per distinct rate matrix; rows point to theirs."""
        if self._eigen is None:
            both, index = np.unique(self._kinds, axis=0, return_inverse=True)
            upper = np.triu_indices(self.k, 1)
            found = []
            for line in both:
                exch, pi = np.zeros((self.k, self.k)), line[self.rr.shape[1] :]
                exch[upper] = line[: self.rr.shape[1]]
                q = (exch + exch.T) * pi
                np.fill_diagonal(q, -q.sum(1))
                root = np.sqrt(pi)
                values, vectors = np.linalg.eigh(root[:, None] * q / root)
                found.append((values, vectors / root[:, None], (vectors * root[:, None]).T))
            self._eigen = np.tile(index.ravel(), self._times), found
        return self._eigen

    def move(self, x: np.ndarray, length: float) -> np.ndarray:
        """Carry vectors of all rows along a branch."""
        if not self.rr.shape[1]:
            stay = np.exp(-self.rate * length)[:, None]
            return stay * x + (1 - stay) * (self.pi * x).sum(1, keepdims=True)
        out = np.empty_like(x)
        index, found = self.eigen()
        for i, (values, left, right) in enumerate(found):
            here = index == i
            inner = (x[here] @ right.T) * np.exp(np.outer(self.rate[here] * length, values))
            out[here] = np.maximum(inner @ left.T, 0.0)
        return out

    def leaf(self, rows: np.ndarray, state: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Vectors at the upper ends of leaf branches, one per (model row, state, length)."""
        if not self.rr.shape[1]:
            stay = np.exp(-self.rate[rows] * length)
            out = np.repeat(((1 - stay) * self.pi[rows, state])[:, None], self.k, axis=1)
            out[np.arange(len(rows)), state] += stay
            return out
        out = np.empty((len(rows), self.k))
        index, found = self.eigen()
        kind = index[rows]
        for i, (values, left, right) in enumerate(found):
            here = kind == i
            inner = right[:, state[here]].T * np.exp(np.outer(self.rate[rows[here]] * length[here], values))
            out[here] = np.maximum(inner @ left.T, 0.0)
        return out


class Message:
    """Sums of logarithms, numbers of zeros and number of observed leaves, by row and state."""

    def __init__(self, log: np.ndarray, zero: np.ndarray, seen: np.ndarray):
        self.log, self.zero, self.seen = log, zero, seen

    @classmethod
    def of(cls, values: np.ndarray, seen: np.ndarray) -> Message:
        none = values <= 0
        return cls(np.log(np.where(none, 1.0, values)), none.astype(np.float64), seen)

    @classmethod
    def ones(cls, block: Block) -> Message:
        return cls(np.zeros((block.n, block.k)), np.zeros((block.n, block.k)), np.zeros(block.n))

    @classmethod
    def read(cls, blob, k: int) -> Message:
        rows = np.frombuffer(blob, "<f8").reshape(-1, 2 * k + 1)
        return cls(rows[:, :k], rows[:, k : 2 * k], rows[:, 2 * k])

    def blob(self) -> bytes:
        return np.hstack([self.log, self.zero, self.seen[:, None]]).astype("<f8").tobytes()

    def scaled(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors with largest entry one (zeros where no state is possible), and the logs taken out."""
        log = np.where(self.zero > 0, -np.inf, self.log)
        top = log.max(1)
        shift = np.where(np.isfinite(top), top, 0.0)
        return np.exp(log - shift[:, None]), shift

    def carried(self, block: Block, length: float) -> Message:
        """The message at the upper end of the branch above the node."""
        x, shift = self.scaled()
        out = Message.of(block.move(x, length), self.seen)
        out.log = np.where(out.zero > 0, 0.0, out.log + shift[:, None])
        return out

    def add(self, other: Message) -> None:
        self.log += other.log
        self.zero += other.zero
        self.seen += other.seen

    def without(self, other: Message) -> Message:
        return Message(self.log - other.log, self.zero - other.zero, self.seen)


def share(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rows divided by their totals; a row of zeros stays."""
    return x / np.where(total > 0, total, 1.0)[:, None]


def _site_block(width: int) -> Column:
    return F.floor(F.col("site") / width)


def _draw_block() -> Column:
    return F.floor(F.col("draw") / BLOCK_DRAWS)


def packed_models(models: DataFrame, width: int, sites: DataFrame | None = None) -> DataFrame:
    """(sb, db, model): blocks of model rows; ``models`` has ([site,] draw, cat, rate, w, pi[, rr]).

    Models without a site hold for all of ``sites``: a block then stores its sites and, once,
    the rows of its draws, so no profile is copied from site to site.
    """
    rest = F.concat("pi", "rr") if "rr" in models.columns else F.col("pi")
    own = F.col("site").cast("bigint") if sites is None else F.lit(0).cast("bigint")
    row = F.struct(
        own.alias("site"), F.col("draw").cast("bigint").alias("draw"), F.col("cat").cast("bigint").alias("cat"),
        F.col("rate").cast("double").alias("rate"), F.col("w").cast("double").alias("w"), rest.alias("v"),
    )
    rows = F.array_sort(F.collect_list(row)).alias("rows")
    if sites is None:
        lists = models.groupBy(_site_block(width).alias("sb"), _draw_block().alias("db")).agg(rows).withColumn("sites", F.array().cast("array<bigint>"))
    else:
        draws = models.groupBy(_draw_block().alias("db")).agg(rows)
        chunks = models.agg(F.array_sort(F.collect_set(_draw_block()))).scalar()  # one number per ``BLOCK_DRAWS`` draws
        held = sites.groupBy(_site_block(width).alias("sb")).agg(F.array_sort(F.collect_set(F.col("site").cast("bigint"))).alias("sites"))
        # few draw blocks meet very many site blocks: each draw block is copied to every salt
        salts = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = held.select("sb", "sites", F.explode(chunks).alias("db"), F.pmod(F.hash("sb"), F.lit(salts)).alias("salt"))
        lists = dealt.join(draws.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["db", "salt"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for value, site in zip(batch.column("rows"), batch.column("sites"), strict=True):
                fields = value.values.flatten()
                fixed = [f.to_numpy(zero_copy_only=False) for f in fields[:_FIXED]]
                vector = fields[_FIXED].flatten().to_numpy(zero_copy_only=False).reshape(len(value.values), -1)
                whole = [np.asarray(f, "<i8")[:, None] for f in fixed[:3]]
                real = [np.asarray(f, "<f8").view("<i8")[:, None] for f in fixed[3:]]
                table = np.hstack([*whole, *real, np.ascontiguousarray(vector, "<f8").view("<i8")])
                here = np.asarray(site.values.to_numpy(zero_copy_only=False), "<i8")
                blobs.append(np.array([table.shape[1], len(here)], "<i8").tobytes() + here.tobytes() + np.ascontiguousarray(table).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("sb"), batch.column("db"), pa.array(blobs, pa.binary())], ["sb", "db", "model"])

    return lists.select("sb", "db", "rows", "sites").mapInArrow(pack, "sb bigint, db bigint, model binary")


def block_size(models: DataFrame) -> tuple[int, int]:
    """(model rows of a site and a block of draws, blocks of draws)."""
    keys = [c for c in ["site"] if c in models.columns]
    each = models.groupBy(*keys, _draw_block().alias("db")).agg(F.count(F.lit(1)).alias("n"))
    most, draws = each.agg(F.max("n"), F.count_distinct("db")).first()
    return max(1, most or 1), draws


def block_width(most: int) -> int:
    """Sites of a block: as many as keep its model rows within ``BLOCK_ROWS``."""
    return max(1, min(BLOCK_SITES, BLOCK_ROWS // most))


def packed_for(cells: DataFrame, models: DataFrame, width: int) -> DataFrame:
    """The packed models of all sites."""
    sites = None if "site" in models.columns else cells.select("site").distinct()
    return packed_models(models, width, sites)


def _each(columns: list[str], schema: str, fn: Callable[..., Iterator[tuple]]) -> Callable:
    """A function over Arrow batches that calls ``fn`` with the Python or buffer values of a row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[batch.column(c) for c in columns], strict=True):
                made = list(fn(*row))
                if made:
                    yield pa.RecordBatch.from_pydict({n: [m[i] for m in made] for i, n in enumerate(names)}, schema=_arrow(schema))

    return run


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def hear(block: Block, out: Message, site: np.ndarray, state: np.ndarray, length: np.ndarray) -> None:
    """Add what observed leaves of the block's sites say."""
    first = np.searchsorted(block.site, site)
    size = np.searchsorted(block.site, site, "right") - first
    for part in np.split(np.arange(len(site)), np.flatnonzero(np.diff(np.cumsum(size) // EXPANDED)) + 1):
        n, ends = size[part], np.cumsum(size[part])
        if not n.sum():
            continue
        rows = np.repeat(first[part] - ends + n, n) + np.arange(ends[-1])
        values = block.leaf(rows, np.repeat(state[part], n), np.repeat(length[part], n))
        said = Message.of(values, np.ones(len(rows)))
        out.seen += np.bincount(rows, minlength=block.n)
        for s in range(block.k):
            out.log[:, s] += np.bincount(rows, said.log[:, s], block.n)
            out.zero[:, s] += np.bincount(rows, said.zero[:, s], block.n)


_MESSAGE = "node string, sb bigint, db bigint, model binary, message binary"


def leaf_messages(cells: DataFrame, tree: DataFrame, packed: DataFrame, states: list[str], width: int) -> DataFrame:
    """What the observed leaves below every inner node say, in parts of ``LEAVES_AT_ONCE`` leaves."""
    k = len(states)
    code = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("state")) - 1
    seen = cells.select(F.col("taxon").cast("string").alias("taxon"), "site", code.alias("ix")).filter("ix >= 0")
    leaves = tree.filter(F.col("taxon").isNotNull() & F.col("parent").isNotNull()).select("node", "parent", "taxon", "length")
    parts = leaves.groupBy("parent").agg(F.ceil(F.count(F.lit(1)) / LEAVES_AT_ONCE).alias("parts"))
    dealt = leaves.join(parts, "parent").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    entry = F.array(F.col("site") - F.col("sb") * width, F.col("ix").cast("bigint")).cast("array<double>")
    rows = dealt.join(seen, "taxon").withColumn("sb", _site_block(width))
    # small bytes, much work per byte: keep the partition number instead of merging by size
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = rows.repartition(n, "parent", "sb", "part").groupBy("parent", "sb", "part").agg(F.collect_list(F.concat(entry, F.array(F.coalesce("length", F.lit(0.0))))).alias("leaves"))

    def step(node, sb, db, model, leaves) -> Iterator[tuple]:
        block = Block(model.as_buffer(), k)
        told = leaves.values.flatten().to_numpy().reshape(-1, 3)
        out = Message.ones(block)
        hear(block, out, told[:, 0].astype(np.int64) + sb.as_py() * width, told[:, 1].astype(np.int64), told[:, 2])
        if out.seen.any():
            yield node.as_py(), sb.as_py(), db.as_py(), model.as_py(), out.blob()

    joined = lists.select(F.col("parent").alias("node"), "sb", "leaves").join(packed, "sb")
    return joined.mapInArrow(_each(["node", "sb", "db", "model", "leaves"], _MESSAGE, step), _MESSAGE)


def added(messages: DataFrame, parts: int, k: int) -> DataFrame:
    """One message per (node, block); at most ``parts`` come from one node."""

    def step(node, sb, db, model, said) -> Iterator[tuple]:
        rows = [np.frombuffer(m.as_buffer(), "<f8") for m in said.values]
        yield node.as_py(), sb.as_py(), db.as_py(), model.as_py(), np.sum(rows, 0).astype("<f8").tobytes()

    keys = ["node", "sb", "db"]
    while True:
        last = parts <= MESSAGES_AT_ONCE
        parts = -(-parts // MESSAGES_AT_ONCE)
        by = [*keys] if last else [*keys, F.pmod(F.xxhash64("message"), F.lit(parts)).alias("_part")]
        lists = messages.groupBy(*by).agg(F.first("model").alias("model"), F.collect_list("message").alias("said"))
        messages = lists.select(*keys, "model", "said").mapInArrow(_each([*keys, "model", "said"], _MESSAGE, step), _MESSAGE)
        if last:
            return messages


def tree_table(nodes: DataFrame) -> DataFrame:
    """The tree with names as text, written down once."""
    return durable(nodes.select(
        F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), F.col("taxon").cast("string").alias("taxon"),
        F.coalesce("length", F.lit(0.0)).alias("length"), "depth",
    ))


def upward(cells: DataFrame, tree: DataFrame, packed: DataFrame, states: list[str], width: int) -> tuple[DataFrame, DataFrame, int]:
    """(messages of all inner nodes with data below, their tree, depth)."""
    k = len(states)
    kids = tree.filter("parent IS NOT NULL").groupBy("parent").agg(
        F.count_if(F.col("taxon").isNull()).alias("inner"), F.ceil(F.count("taxon") / LEAVES_AT_ONCE).alias("parts")
    )
    spread = kids.agg(F.max(F.col("inner") + F.col("parts"))).first()[0] or 1
    depth = tree.agg(F.max("depth")).first()[0] or 0
    if not depth and not tree.filter("taxon IS NOT NULL").isEmpty():
        raise ValueError("a tree of one leaf has no branch")
    inner = tree.filter(F.col("taxon").isNull())
    said = durable(leaf_messages(cells, tree, packed, states, width).join(inner.select("node", F.col("depth")), "node"))

    def step(node, sb, db, model, message, parent, length) -> Iterator[tuple]:
        block = Block(model.as_buffer(), k)
        up = Message.read(message.as_buffer(), k).carried(block, length.as_py())
        yield parent.as_py(), sb.as_py(), db.as_py(), model.as_py(), up.blob()

    columns = ["node", "sb", "db", "model", "message"]
    done: DataFrame | None = None
    level: DataFrame | None = None
    for d in range(depth - 1, -1, -1):
        own = said.filter(F.col("depth") == d).select(*columns)
        if level is not None:
            below = level.join(inner.filter(F.col("depth") == d + 1).select("node", "parent", "length"), "node")
            own = own.unionByName(below.mapInArrow(_each([*columns, "parent", "length"], _MESSAGE, step), _MESSAGE))
        level = added(own, int(spread), k)
        if (depth - d) % LEVELS_PER_CUT == 0:
            level = durable(level)
        done = level if done is None else done.unionByName(level)
    return (said.select(*columns) if done is None else done), inner, int(depth)


def row_logl(block: Block, message: Message) -> np.ndarray:
    """Log-likelihood of every model row from the message at the root; 0 where no leaf is observed."""
    x, shift = message.scaled()
    with np.errstate(divide="ignore"):
        found = np.log((x * block.pi).sum(1)) + shift
    return np.where(message.seen > 0, found, 0.0)


def root_logl(packed: DataFrame, root: DataFrame, k: int) -> DataFrame:
    """(draw, site, cat, logl) of all model rows; ``root`` has the messages of the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, message in zip(batch.column("model"), batch.column("message"), strict=True):
                block = Block(model.as_buffer(), k)
                said = Message.read(message.as_buffer(), k) if message.is_valid else Message.ones(block)
                yield _logl_batch(block, said)

    joined = packed.join(root.select("sb", "db", "message"), ["sb", "db"], "left").select("model", "message")
    return joined.mapInArrow(run, _LOGL)


_ABOVE = "node string, sb bigint, db bigint, model binary, message binary, above binary"


def downward(ups: DataFrame, inner: DataFrame, depth: int, k: int) -> DataFrame:
    """Rows (node, sb, db, model, message, above) of all inner nodes in blocks with data.

    ``above`` is what the rest of the tree says, and the row's log-likelihood beside it.
    """
    columns = ["node", "sb", "db", "model", "message"]

    def start(node, sb, db, model, message) -> Iterator[tuple]:
        block, said = Block(model.as_buffer(), k), Message.read(message.as_buffer(), k)
        above = np.hstack([np.ones((block.n, k)), row_logl(block, said)[:, None]])
        above[said.seen == 0, k] = np.nan
        yield node.as_py(), sb.as_py(), db.as_py(), model.as_py(), message.as_py(), above.astype("<f8").tobytes()

    def step(node, sb, db, model, message, above, child, length, own) -> Iterator[tuple]:
        block, said = Block(model.as_buffer(), k), Message.read(message.as_buffer(), k)
        rest = np.frombuffer(above.as_buffer(), "<f8").reshape(-1, k + 1)
        mine = Message.read(own.as_buffer(), k) if own.is_valid else Message.ones(block)
        others = said.without(mine.carried(block, length.as_py()))
        x = others.scaled()[0] * rest[:, :k]
        moved = block.move(share(x, x.max(1)), length.as_py())
        out = np.hstack([share(moved, moved.max(1)), rest[:, k:]])
        yield child.as_py(), sb.as_py(), db.as_py(), model.as_py(), mine.blob(), out.astype("<f8").tobytes()

    root = inner.filter(F.col("depth") == 0).select("node")
    level = ups.join(root, "node").select(*columns).mapInArrow(_each(columns, _ABOVE, start), _ABOVE)
    done = level
    for d in range(1, depth):
        kids = inner.filter(F.col("depth") == d).select(F.col("node").alias("child"), F.col("parent").alias("node"), "length")
        own = ups.select(F.col("node").alias("child"), "sb", "db", F.col("message").alias("own"))
        joined = level.join(kids, "node").join(own, ["child", "sb", "db"], "left")
        level = joined.mapInArrow(_each([*columns, "above", "child", "length", "own"], _ABOVE, step), _ABOVE)
        if d % LEVELS_PER_CUT == 0:
            level = durable(level)
        done = done.unionByName(level)
    return done


def state_sums(block: Block, logl: np.ndarray, message: Message, above: np.ndarray, raw_sum: bool) -> list[np.ndarray]:
    """[site, draws with a likelihood, sum of every state's probability] of a node in a block."""
    joint = message.scaled()[0] * above * block.pi
    probs = share(joint, joint.sum(1))
    seen = ~np.isnan(logl)
    # categories to (draw, site), then draws to sites; rows stand by site and draw
    fresh = np.append(True, (np.diff(block.site) != 0) | (np.diff(block.draw) != 0))
    point = np.cumsum(fresh) - 1
    if raw_sum:
        w = seen.astype(np.float64)
    else:
        top = np.full(point[-1] + 1, -np.inf)
        np.maximum.at(top, point[seen], logl[seen])
        high = np.where(np.isfinite(top), top, 0.0)[point]
        w = np.where(seen, block.weight * np.exp(np.where(seen, logl, -np.inf) - high), 0.0)
    total = np.bincount(point, w)
    known = total > 0  # a point without data or likelihood has no ancestral states
    sites, place = np.unique(block.site[fresh], return_inverse=True)
    n = np.bincount(place[known], minlength=len(sites))
    kept = n > 0
    columns = [np.bincount(place[known], np.bincount(point, w * probs[:, i])[known] / total[known], len(sites))[kept] for i in range(block.k)]
    return [sites[kept], n[kept], *columns]


def _sums_schema(k: int) -> str:
    return "node string, site bigint, n bigint, " + ", ".join(f"s{i} double" for i in range(k))


def _sums_batch(node: str | None, found: list[np.ndarray]) -> pa.RecordBatch:
    names = ["node", "site", "n", *[f"s{i}" for i in range(len(found) - 2)]]
    return pa.RecordBatch.from_arrays([pa.array([node] * len(found[0]), pa.string()), *map(pa.array, found)], names)


def posterior_sums(downs: DataFrame, k: int, raw_sum: bool) -> DataFrame:
    """(node, site, n, s0, s1, ...): draws with a likelihood and their summed state probabilities, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, model, message, above in zip(*[batch.column(c) for c in ("node", "model", "message", "above")], strict=True):
                rest = np.frombuffer(above.as_buffer(), "<f8").reshape(-1, k + 1)
                block, said = Block(model.as_buffer(), k), Message.read(message.as_buffer(), k)
                yield _sums_batch(node.as_py(), state_sums(block, rest[:, k], said, rest[:, :k], raw_sum))

    return downs.select("node", "model", "message", "above").mapInArrow(run, _sums_schema(k))


# ---- all levels of a block in one task ----------------------------------------------------


class Order:
    """Inner nodes in the order in which they are finished, children before their parent.

    The child with most nodes below comes first, so at any time only a logarithmic number
    of nodes has heard some of its children and not all.
    """

    def __init__(self, names: list[str], parent: np.ndarray, length: np.ndarray):
        self.names, self.parent, self.length = names, parent, length

    @classmethod
    def of(cls, tree: DataFrame) -> Order | None:
        """None for more than ``NODES_AT_ONCE`` nodes, or if they are no tree with one root and a name for every node."""
        depth = tree.agg(F.max("depth")).first()[0] or 0
        inner = tree.filter(F.col("taxon").isNull() & (F.col("depth") < depth))
        rows = inner.select("node", "parent", "length", "depth").limit(NODES_AT_ONCE + 1).collect()
        place = {r.node: i for i, r in enumerate(rows)}
        roots = [r.node for r in rows if r.depth == 0]
        whole = len(rows) <= NODES_AT_ONCE and len(place) == len(rows) and None not in place and len(roots) == 1
        if not whole or any(r.depth and (r.parent not in place or rows[place[r.parent]].depth != r.depth - 1) for r in rows):
            return None
        below: dict[str, list[str]] = {}
        size = dict.fromkeys(place, 1)
        for r in sorted(rows, key=lambda r: -r.depth):
            if r.depth:
                below.setdefault(r.parent, []).append(r.node)
                size[r.parent] += size[r.node]
        names, todo = [], roots
        while todo:  # parents first and the largest child last; turned round below
            names.append(node := todo.pop())
            todo.extend(sorted(below.get(node, ()), key=size.__getitem__, reverse=True))
        names.reverse()
        number = {x: i for i, x in enumerate(names)}
        at = [rows[place[x]] for x in names]
        parent = np.array([number[r.parent] if r.depth else -1 for r in at], np.int64)
        return cls(names, parent, np.array([r.length for r in at], np.float64))


class Pass:
    """The messages of one block on their way up."""

    def __init__(self, key: tuple[int, int], order: Order, keep: bool):
        self.key, self.order, self.keep = key, order, keep
        self.block: Block | None = None
        self.root: Message | None = None
        self.open: dict[int, Message] = {}
        self.due: list[int] = []
        self.done: dict[int, Message] = {}

    def at(self, node: int) -> Message:
        if node not in self.open:
            self.open[node] = Message.ones(self.block)
            heappush(self.due, node)
        return self.open[node]

    def close(self, below: int) -> None:
        """Finish all nodes before ``below``."""
        while self.due and self.due[0] < below:
            node = heappop(self.due)
            said, parent = self.open.pop(node), int(self.order.parent[node])
            if self.keep:
                self.done[node] = said
            if parent < 0:
                self.root = said
            else:
                self.at(parent).add(said.carried(self.block, self.order.length[node]))

    def down(self, logl: np.ndarray, raw_sum: bool) -> Iterator[pa.RecordBatch]:
        """The states of all inner nodes, parents first."""
        none = Message.ones(self.block)
        above = {len(self.order.names) - 1: np.ones((self.block.n, self.block.k))}
        for node in range(len(self.order.names) - 1, -1, -1):
            said, parent, length = self.done.get(node, none), int(self.order.parent[node]), self.order.length[node]
            if parent >= 0:
                others = self.done.get(parent, none).without(said.carried(self.block, length))
                x = others.scaled()[0] * above[parent]
                moved = self.block.move(share(x, x.max(1)), length)
                above[node] = share(moved, moved.max(1))
            yield _sums_batch(self.order.names[node], state_sums(self.block, logl, said, above[node], raw_sum))


_NONE = -(1 << 63)


def block_passes(
    cells: DataFrame, tree: DataFrame, models: DataFrame, packed: DataFrame, states: list[str], width: int, order: Order, keep: bool,
    out: Callable[[Pass], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """``out`` of every block whose messages have reached the root.

    A block's model rows come first (node -1), then its cells by the number of the node above their leaf.
    """
    k = len(states)
    spark = cells.sparkSession
    code = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("state")) - 1
    seen = cells.select(F.col("taxon").cast("string").alias("taxon"), F.col("site").cast("bigint").alias("site"), code.alias("ix")).filter("ix >= 0 AND site IS NOT NULL")
    numbers = F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(order.names)], "parent string, at int"))
    leaves = tree.filter("taxon IS NOT NULL").join(numbers, "parent").select("taxon", "at", "length")
    chunks = models.agg(F.array_sort(F.collect_set(_draw_block()))).scalar()
    told = leaves.join(seen, "taxon").select(
        _site_block(width).alias("sb"), F.explode(chunks).alias("db"), "at", "site", "ix", "length", F.lit(None).cast("binary").alias("model")
    )
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("site", "bigint"), ("ix", "bigint"), ("length", "double"))]
    # every block is much work for few bytes: keep the partition number instead of merging by size
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = packed.select("sb", "db", F.lit(-1).alias("at"), *none, "model").unionByName(told).repartition(n, "sb", "db").sortWithinPartitions("sb", "db", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(one: Pass | None) -> Iterator[pa.RecordBatch]:
            if one is not None and one.block is not None:
                one.close(len(order.names))
                yield from out(one)

        now: Pass | None = None
        for batch in batches:
            sb, db = (pc.fill_null(batch.column(c), _NONE).to_numpy() for c in ("sb", "db"))
            at = batch.column("at").to_numpy()
            site, ix = (pc.fill_null(batch.column(c), 0).to_numpy() for c in ("site", "ix"))
            length = pc.fill_null(batch.column("length"), 0.0).to_numpy()
            cuts = np.flatnonzero((np.diff(sb) != 0) | (np.diff(db) != 0) | (np.diff(at) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sb)], strict=True):
                if a == b:
                    continue
                key = int(sb[a]), int(db[a])
                if now is None or now.key != key:
                    yield from ended(now)
                    now = Pass(key, order, keep)
                if at[a] < 0:
                    now.block = Block(batch.column("model")[a].as_buffer(), k)
                elif now.block is not None:
                    now.close(int(at[a]))
                    hear(now.block, now.at(int(at[a])), site[a:b], ix[a:b], length[a:b])
        yield from ended(now)

    return rows.mapInArrow(run, schema)


_LOGL = "draw bigint, site bigint, cat int, logl double"


def _logl_batch(block: Block, said: Message) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(block.draw), pa.array(block.site), pa.array(block.cat, pa.int32()), pa.array(row_logl(block, said))], ["draw", "site", "cat", "logl"]
    )


def block_logl(cells: DataFrame, tree: DataFrame, models: DataFrame, states: list[str], order: Order) -> DataFrame:
    """(draw, site, cat, logl) of all model rows, no message leaving its block."""
    width = block_width(block_size(models)[0])

    def out(one: Pass) -> Iterator[pa.RecordBatch]:
        yield _logl_batch(one.block, Message.ones(one.block) if one.root is None else one.root)

    return block_passes(cells, tree, models, packed_for(cells, models, width), states, width, order, False, out, _LOGL)


def block_posteriors(cells: DataFrame, tree: DataFrame, models: DataFrame, states: list[str], order: Order, raw_sum: bool) -> tuple[DataFrame, bool] | None:
    """Rows of :func:`posterior_sums` and whether a (node, site) has only one; None if a block's messages don't fit ``KEPT_BYTES``."""
    most, draws = block_size(models)
    k = len(states)
    width = min(block_width(most), KEPT_BYTES // (8 * (3 * k + 1) * most * len(order.names)))
    if not width:
        return None

    def out(one: Pass) -> Iterator[pa.RecordBatch]:
        if one.root is not None:
            logl = row_logl(one.block, one.root)
            yield from one.down(np.where(one.root.seen > 0, logl, np.nan), raw_sum)

    sums = block_passes(cells, tree, models, packed_for(cells, models, width), states, width, order, True, out, _sums_schema(k))
    return sums, draws <= 1
