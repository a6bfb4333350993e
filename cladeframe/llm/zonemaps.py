"""Exact integer k-means over vectors in Hilbert order with zone maps.

Vectors are sorted along a Hilbert curve through the cube that holds them and cut into
blocks; a block keeps the least and greatest value of every component, the sum of its
vectors and the vectors. The distance from a centroid to a block's box bounds the
distances to all of its vectors from below, that to the box's farthest corner from above.
Centroids whose lower bound exceeds the least upper bound can't be nearest to any vector
of the block; the others are compared exactly. A block with one candidate gives its
stored sum and isn't read further while centroids move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import durable, id_type

_BITS = 4
_ROWS = 512
#: Squared distances of 64 components within this bound fit a 64-bit integer.
_LARGEST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Place of integer points on the Hilbert curve, as rows of bytes that sort like it.

    ``cells`` holds coordinates of ``bits`` bits, one row a point. From the highest bit
    down, the first coordinate is flipped or swapped with each other one, so that every
    sub-cube is entered where the one before was left; a Gray code then orders the bits.
    """
    x = np.ascontiguousarray(cells.T).astype(np.uint8 if bits <= 8 else np.uint32)
    head = x[0]
    for level in range(bits - 1, 0, -1):
        lower = (1 << level) - 1
        for axis in x:
            set_here = axis >> level & 1
            mixed = (head ^ axis) & lower
            head ^= np.where(set_here, lower, mixed).astype(x.dtype)
            axis ^= np.where(set_here, 0, mixed).astype(x.dtype)  # nothing to swap for the first itself
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turn = np.zeros_like(head)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0).astype(x.dtype)
    x ^= turn
    planes = np.stack([x >> level & 1 for level in range(bits - 1, -1, -1)])  # bit, axis, point
    return np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Centroids that may be nearest to a vector of the box, ascending."""
    under, over = low - centers, centers - high
    gap = np.maximum(np.maximum(under, over), 0)
    reach = np.maximum(np.abs(under), np.abs(over))
    nearest, farthest = (gap * gap).sum(1), (reach * reach).sum(1)
    return np.flatnonzero(nearest <= farthest.min())


def nearest(rows: np.ndarray, centers: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row among those given (ties: the first) and the squared distance."""
    best = np.full(len(rows), among[0])
    least = ((rows - centers[among[0]]) ** 2).sum(1)
    for c in among[1:]:
        far = ((rows - centers[c]) ** 2).sum(1)
        closer = far < least
        best[closer], least[closer] = c, far[closer]
    return best, least


def _list(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(vectors: DataFrame, dim: int, rows: int) -> DataFrame:
    """Rows (ids, n, low, high, total, cells): blocks of vectors in Hilbert order.

    Equal vectors share a place on the curve and are spread by a digest of their ids.
    """
    span = vectors.agg(F.min(F.array_min("v")).alias("a"), F.max(F.array_max("v")).alias("b")).first()
    low, high = span["a"] or 0, span["b"] or 0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = (_list(batch.column("v"), dim) - low) * (1 << _BITS) // (high - low + 1)
            keys = pa.array([k.tobytes() for k in hilbert_keys(cells)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("v"), keys], ["k", "v", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0

        def block(table: pa.Table) -> pa.RecordBatch:
            values = _list(table.column("v").combine_chunks(), dim)
            return pa.RecordBatch.from_pylist([{
                "ids": table.column("k").to_pylist(), "n": len(values),
                "low": values.min(0).tolist(), "high": values.max(0).tolist(), "total": values.sum(0).tolist(),
                "cells": values.astype("<i4").tobytes(),
            }], schema=shape)

        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= rows:
                table = pa.Table.from_batches(held)
                for a in range(0, waiting - rows + 1, rows):
                    yield block(table.slice(a, rows))
                rest = waiting % rows
                held, waiting = table.slice(len(table) - rest).to_batches(), rest
        if waiting:
            yield block(pa.Table.from_batches(held))

    longs = pa.list_(pa.int64())
    shape = pa.schema([("ids", pa.list_(pa.string())), ("n", pa.int64()), ("low", longs), ("high", longs), ("total", longs), ("cells", pa.binary())])
    placed = vectors.mapInArrow(keyed, "k string, v array<bigint>, place binary")
    tie = F.xxhash64("k")
    ordered = placed.repartitionByRange("place", tie).sortWithinPartitions("place", tie, "k").select("k", "v")
    return durable(ordered.mapInArrow(
        cut, "ids array<string>, n bigint, low array<bigint>, high array<bigint>, total array<bigint>, cells binary"
    ))


def _sums(blocks: DataFrame, centers: np.ndarray, distances: bool) -> list[tuple[int, list[int], int]]:
    """Vectors, component sums and (where asked for) inertia of every cluster; one row a cluster is collected."""
    many, dim = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, inertia = [0] * many, np.zeros((many, dim), np.int64), [0] * many
        for batch in batches:
            lows, highs, totals = (_list(batch.column(c), dim) for c in ("low", "high", "total"))
            sizes = batch.column("n").to_pylist()
            for row, cells in enumerate(batch.column("cells")):
                among = candidates(lows[row], highs[row], centers)
                if len(among) == 1 and not distances:
                    count[among[0]] += sizes[row]
                    total[among[0]] += totals[row]
                    continue
                values = np.frombuffer(cells.as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
                best, far = nearest(values, centers, among)
                for c in among.tolist():
                    mine = best == c
                    count[c] += int(mine.sum())
                    total[c] += values[mine].sum(0)
                    inertia[c] += int(far[mine].sum())
        yield pa.RecordBatch.from_pydict({
            "c": pa.array(range(many), pa.int32()), "n": pa.array(count, pa.int64()),
            "total": pa.array(total.tolist(), pa.list_(pa.int64())), "inertia": pa.array(inertia, pa.int64()),
        })

    parts = blocks.select("n", "low", "high", "total", "cells").mapInArrow(run, "c int, n bigint, total array<bigint>, inertia bigint")
    added = parts.groupBy("c").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total"), F.sum("inertia").alias("inertia")
    )
    found = {r["c"]: (r["n"], list(r["total"]), r["inertia"]) for r in added.collect()}
    return [found.get(c, (0, [0] * dim, 0)) for c in range(many)]


def cluster_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = 8,
    rounds: int = 10,
    dim: int = 64,
    scale: int = 1024,
    seed: int = 3,
    block_rows: int = _ROWS,
) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of ``dim`` finite components; a component x counts as the integer
    floor(scale * x). Vectors with an integer beyond 2^27 either way have squared distances
    that no long holds and are left out like infinite ones. The first centroids are the
    ``clusters`` kept vectors with the smallest digest of ``seed:id`` (fewer where fewer are
    kept; equal digests, as of repeated or null ids, by vector). A null id is digested as
    an empty one and stays null; repeated rows are rows of their own; an empty table gives
    no rows; other columns are not read whatever their names.
    """
    kind = id_type(df, id_col)
    x = F.col("x")
    whole = F.transform(x, lambda c: F.floor(c * scale))
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) <= _LARGEST))
    given = df.select(F.col(id_col).cast("string").alias("k"), F.col(vector_col).cast("array<double>").alias("x"))
    kept = given.filter(F.col("x").isNotNull() & (F.size("x") == dim)).filter(fits).select("k", whole.alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("k", F.lit(""))), 256)
    first = kept.select(digest.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()  # ``clusters`` rows
    centers = np.array([r["v"] for r in first], np.int64).reshape(-1, dim)
    many = len(centers)
    blocks = _blocks(kept, dim, block_rows) if many else None
    for _ in range(rounds if many else 0):
        for c, (n, total, _) in enumerate(_sums(blocks, centers, False)):
            if n:
                centers[c] = [t // n for t in total]
    schema = f"{id_col} string, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not many:
        empty = df.sparkSession.createDataFrame([], schema)
        return empty.withColumn(id_col, F.col(id_col).cast(kind))
    inertia = [s[2] for s in _sums(blocks, centers, True)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = (_list(batch.column(c), dim) for c in ("low", "high"))
            for row, (ids, cells) in enumerate(zip(batch.column("ids"), batch.column("cells"), strict=True)):
                values = np.frombuffer(cells.as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
                best, far = nearest(values, centers, candidates(lows[row], highs[row], centers))
                yield pa.RecordBatch.from_arrays([
                    ids.values, pa.array(best, pa.int32()), pa.array(far, pa.int64()),
                    pa.array([inertia[c] for c in best], pa.int64()), pa.array([sum(inertia)] * len(best), pa.int64()),
                    pa.array([names[c] for c in best], pa.string()),
                ], names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    out = blocks.select("ids", "low", "high", "cells").mapInArrow(told, schema)
    return out.withColumn(id_col, F.col(id_col).cast(kind))
