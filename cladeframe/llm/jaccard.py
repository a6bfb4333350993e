"""N-gram Jaccard join of whole texts.

1. Every text becomes the set of its word shingles (64-bit hashes). Texts with equal
   sets form one class; only classes are compared.
2. Shingles are ordered by their frequency over all documents, rarest first, ties by
   hash. The frequency is read from a table of fixed size whose counters are shared
   by hashing; any order that is the same everywhere is valid, and shared counters
   only blur it among the rare.
3. A class sends the first n - ceil(t n) + 1 shingles of its set, packed into blocks
   of buckets. Inside a bucket a shingle's classes meet; length and positional
   filters apply. First each class is paired with the class that holds the shingle
   at the earliest position, which settles large families with one pair each.
   Of these a class keeps the one it shares most prefix shingles with.
4. Pairs are verified once: first the suffix filter, which cuts both sets at fixed
   places of the hash range and bounds the overlap by the parts' sizes, on vectors of
   a few bits per shingle; then the exact count on the sets. Verified links give components; the
   second round pairs only classes of different components that pass all filters, so
   no link between components is lost and no family is expanded into all its pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import components, durable, id_type, release

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_COUNTERS = 19  # bits of each of the two counter rows
_SLICES = 32
_ROWS = 512  # texts of a batch held as Python strings
_FLUSH = 200_000  # prefix entries per block of a map task
_BUCKET = 400_000  # prefix entries per bucket


class Shingler:
    """Distinct shingle hashes of a text, sorted."""

    def __init__(self, words: int = 5):
        self.words = words
        rng = np.random.default_rng(20240607)
        self.byte = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 2 * len(self.power), 1 << 12)
            steps = np.full(size, _ODD)
            back = np.full(size, _ODD_INVERSE)
            steps[0] = back[0] = 1
            self.power, self.inverse = np.cumprod(steps), np.cumprod(back)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        data = np.frombuffer(b" ".join(words), np.uint8)
        self._grow(len(data) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.byte[data] * self.power[: len(data)])))
        gaps = np.flatnonzero(data == 32)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(data)]))
        last = min(self.words, len(words)) - 1
        starts, ends = starts[: len(starts) - last], ends[last:]
        h = (total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        h.sort()
        return h if len(h) < 2 else h[np.concatenate(([True], h[1:] != h[:-1]))]


def counters(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << _COUNTERS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(_COUNTERS)) & mask).astype(np.int64)


def frequency(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = counters(h)
    return np.minimum(table[0][a], table[1][b])


def fingerprint(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def segments(h: np.ndarray) -> np.ndarray:
    """How many of the hashes lie in each of 2^k equal parts of the hash range, about one on average."""
    bits = max(6, (max(len(h), 1) - 1).bit_length())
    return np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u2")


def apart(one: np.ndarray, two: np.ndarray) -> int:
    """Least number of shingles that only one of two sets has, from their part sizes."""
    if len(one) > len(two):
        one, two = two, one
    return int(np.abs(one.astype(np.int64) - two.reshape(len(one), -1).sum(1)).sum())


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A bounded number of rows at a time with their texts: a batch of long texts is never all Python strings at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            part = batch.slice(a, _ROWS)
            yield part, part.column("t").to_pylist()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per row (k, n, c, seg): set size, class, part sizes; per task slices of its shingle counters."""

    names = ["k", "n", "c", "slice", "data"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        table = np.zeros((2, 1 << _COUNTERS), np.int64)
        some = False
        for part, texts in sliced(batches):
            n, c, seg = [], [], []
            for text in texts:
                h = shingler(text)
                n.append(len(h))
                c.append(fingerprint(h))
                seg.append(zlib.compress(segments(h).tobytes(), 1))
                for row, at in enumerate(counters(h)):
                    np.add.at(table[row], at, 1)
                some |= len(h) > 0
            yield rows(part.column("k").to_pylist(), n, c, [-1] * len(n), seg)
        if some:
            flat = table.reshape(_SLICES, -1)
            blobs = [zlib.compress(x.tobytes(), 1) for x in flat]
            yield rows([None] * _SLICES, [0] * _SLICES, [0] * _SLICES, range(_SLICES), blobs)
        release()

    schema = "k string, n bigint, c bigint, slice int, data binary"
    made = docs.withColumn("k", F.col("k").cast("string")).mapInArrow(run, schema)
    return made.withColumn("k", F.col("k").cast(id_type(docs, "k")))


def counter_table(slices: DataFrame) -> np.ndarray:
    """The summed counters: two rows of fixed size, whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch["slice"], batch["data"], strict=True):
                part = np.frombuffer(zlib.decompress(blob), np.int64)
                total[s] = total[s] + part if s in total else part
        yield pd.DataFrame({"slice": list(total), "counts": [x.tobytes() for x in total.values()]})

    rows = slices.repartition(_SLICES, "slice").mapInPandas(run, "slice int, counts binary").collect()
    table = np.zeros((_SLICES, (2 << _COUNTERS) // _SLICES), np.int64)
    for r in rows:
        table[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return table.reshape(2, 1 << _COUNTERS)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix_blocks(docs: DataFrame, words: int, percent: int, table, buckets: int) -> DataFrame:
    """Prefix entries (shingle, class, set size, position) as packed blocks of one bucket each."""

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        h, c, n, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = ((h * _ODD) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        names = bucket[order][cut]
        columns = {x: [y.tobytes() for y in np.split(v[order], cut[1:])] for x, v in (("h", h), ("c", c), ("n", n), ("p", p))}
        blobs = [pa.array(x, pa.binary()) for x in columns.values()]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *blobs], ["bucket", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(words), table.value
        parts: list[tuple] = []
        size = 0
        sent: set[int] = set()
        for _, texts in sliced(batches):
            for text in texts:
                h = shingler(text)
                if not len(h):
                    continue
                c = fingerprint(h)
                if c in sent:
                    continue  # the class has sent its prefix from this task
                sent.add(c)
                m = prefix_length(len(h), percent)
                f = frequency(counts, h)
                first = np.argsort(f, kind="stable")[:m] if m < len(h) else np.argsort(f, kind="stable")
                m = len(first)
                parts.append((h[first], np.full(m, c), np.full(m, len(h), np.int32), np.arange(m, dtype=np.int32)))
                size += m
                if size >= _FLUSH:
                    yield packed(parts)
                    parts, size, sent = [], 0, set()
        if parts:
            yield packed(parts)
        parts, sent = [], set()
        release()

    return docs.select("t").mapInArrow(run, "bucket bigint, h binary, c binary, n binary, p binary")


def needed(n, m, percent: int):
    """Least overlap of two sets of these sizes: ceil(percent (n + m) / (100 + percent))."""
    return -(-percent * (n + m) // (100 + percent))


def has_partner(h: np.ndarray, n: np.ndarray, p: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Entries, sorted by shingle, with a partner that length and position allow.

    Shingles of up to 64 classes are compared in full; all entries of others stay.
    """
    keep = size > 64
    at = np.flatnonzero((size > 1) & ~keep)
    rest = n - p
    for step in range(1, 64):
        at = at[at + step < len(h)]
        at = at[h[at] == h[at + step]]
        if not len(at):
            break
        to = at + step
        fine = 100 * np.minimum(n[at], n[to]) >= percent * np.maximum(n[at], n[to])
        fine &= np.minimum(rest[at], rest[to]) >= needed(n[at], n[to], percent)
        keep[at[fine]] = keep[to[fine]] = True
    return keep


def shared_entries(blocks: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Entries of shingles that two classes or more send, each with the class to try first.

    The first class of a shingle is the one that holds it earliest in its order;
    ``first`` is null where length or position rule the pair out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[str, list[bytes]] = {"h": [], "c": [], "n": [], "p": []}
        for batch in batches:
            for x, blobs in parts.items():
                blobs += list(batch[x])
        kinds = {"h": np.uint64, "c": np.int64, "n": np.int32, "p": np.int32}
        h, c, n, p = (np.frombuffer(b"".join(parts.pop(x)), kind) for x, kind in kinds.items())
        order = np.argsort(h, kind="stable")
        h = h[order]
        twice = np.concatenate((h[1:] == h[:-1], [False]))
        twice[1:] |= twice[:-1]
        order = order[twice[: len(order)]]
        h, c, n, p = h[twice[: len(h)]], c[order], n[order].astype(np.int64), p[order].astype(np.int64)
        order = np.lexsort((c, p, h))
        h, c, n, p = h[order], c[order], n[order], p[order]
        if len(h):
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            h, c, n, p = h[fresh], c[fresh], n[fresh], p[fresh]
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            keep = has_partner(h, n, p, np.repeat(np.diff(edge), np.diff(edge)), percent)
            h, c, n, p = h[keep], c[keep], n[keep], p[keep]
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
            first = np.repeat(edge[:-1], np.diff(edge))
            fc, fn, fp = c[first], n[first], p[first]
            good = (c != fc) & (100 * np.minimum(n, fn) >= percent * np.maximum(n, fn))
            good &= np.minimum(n - p, fn - fp) >= needed(n, fn, percent)
            for a in range(0, len(h), 100_000):
                s = slice(a, a + 100_000)
                yield pd.DataFrame({
                    "h": h[s].view(np.int64), "c": c[s], "n": n[s], "p": p[s],
                    "first": pd.Series(fc[s], dtype="Int64").where(good[s]),
                })

    schema = "h bigint, c bigint, n bigint, p bigint, first bigint"
    return blocks.repartition(buckets, "bucket").mapInPandas(run, schema)


def class_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(c, set) of the wanted classes, one row per class.

    A bit map of fixed size tells a map task which sets are surely not wanted; the
    join with the wanted classes decides.
    """
    bits = 24
    slot = F.shiftrightunsigned("c", 64 - bits)  # a class is a hash already
    marks = classes.select(slot.alias("s")).distinct()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[batch["s"].to_numpy()] = True
        yield pd.DataFrame({"m": [zlib.compress(np.packbits(seen).tobytes(), 1)]})

    wanted = np.zeros((1 << bits) // 8, np.uint8)
    for r in marks.repartition(8, "s").mapInPandas(pack, "m binary").toLocalIterator():
        wanted |= np.frombuffer(zlib.decompress(r["m"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(wanted.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        marked = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        sent: set[int] = set()
        for _, texts in sliced(batches):
            named, sets = [], []
            for text in texts:
                h = shingler(text)
                if len(h):
                    c = fingerprint(h)
                    if c not in sent and marked[(c & (1 << 64) - 1) >> (64 - bits)]:
                        sent.add(c)
                        named.append(c)
                        sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), pa.array(sets, pa.binary())], ["c", "set"])
        release()

    found = docs.select("t").mapInArrow(run, "c bigint, set binary")
    return found.groupBy("c").agg(F.first("set").alias("set"))


def possible_pairs(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the suffix filter lets through; ``parts`` has (c, n, seg) once per class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                one, two = (np.frombuffer(zlib.decompress(z), "<u2") for z in (x, y))
                n, m = int(one.sum()), int(two.sum())
                good.append(n + m - apart(one, two) >= 2 * needed(n, m, percent))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    left = parts.select(F.col("c").alias("a"), F.col("seg").alias("sa"))
    right = parts.select(F.col("c").alias("b"), F.col("seg").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInPandas(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                good.append(int((v[at] == u).sum()) >= needed(len(u), len(v), percent))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    left = sets.select(F.col("c").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("c").alias("b"), F.col("set").alias("sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInPandas(run, "a bigint, b bigint")


def cross_pairs(entries: DataFrame, roots: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a prefix shingle and pass all filters."""
    rooted = durable(
        entries.join(roots.select(F.col("node").alias("c"), "root"), "c", "left")
        .select("h", "c", "n", (F.col("n") - F.col("p")).alias("rest"), F.coalesce("root", "c").alias("root"))
    )

    def possible(na: Column, nb: Column, ra: Column, rb: Column) -> Column:
        return F.least(ra, rb) * (100 + percent) >= percent * (na + nb)

    by_root = rooted.groupBy("h", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"))
    several = by_root.groupBy("h").agg(F.count(F.lit(1)).alias("r")).filter("r > 1").select("h")
    by_root = by_root.join(several, "h", "left_semi")
    x, y = by_root.alias("x"), by_root.alias("y")
    spans = (100 * F.col("x.hi") >= percent * F.col("y.lo")) & (100 * F.col("y.hi") >= percent * F.col("x.lo"))
    both = x.join(
        y,
        (F.col("x.h") == F.col("y.h")) & (F.col("x.root") < F.col("y.root")) & spans
        & possible(F.col("x.lo"), F.col("y.lo"), F.col("x.rest"), F.col("y.rest")),
    ).select(F.col("x.h").alias("h"), F.col("x.root").alias("xr"), F.col("y.root").alias("yr"))
    one = rooted.select("h", F.col("root").alias("xr"), F.col("c").alias("xc"), F.col("n").alias("xn"), F.col("rest").alias("xs"))
    two = rooted.select("h", F.col("root").alias("yr"), F.col("c").alias("yc"), F.col("n").alias("yn"), F.col("rest").alias("ys"))
    near = 100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")
    pairs = (
        both.join(one, ["h", "xr"])
        .join(two, ["h", "yr"])
        .filter(near & possible(F.col("xn"), F.col("yn"), F.col("xs"), F.col("ys")))
        .select(F.least("xc", "yc").alias("a"), F.greatest("xc", "yc").alias("b"))
        .distinct()
    )
    return pairs.join(tried, ["a", "b"], "left_anti")


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75
) -> DataFrame:
    """One row per input row: id, n_shingles and component_id (the smallest id reachable by links).

    A text with fewer than ``words`` words is one shingle; a null text or one without
    words has none, links with nothing and is its own component. Null ids take part
    but are never the smallest id; rows that share an id are compared as separate
    texts. An empty table gives no rows; other columns are not read.

    ``percent`` must be above 50. Equal hashes of 64 bits count as equal.
    """
    docs = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    signed = durable(signatures(docs, words))
    rows_with_parts = signed.filter("slice < 0").select("k", "n", "c", F.col("data").alias("seg"))
    rows = rows_with_parts.drop("seg")
    shared = docs.sparkSession.sparkContext.broadcast(counter_table(signed.filter("slice >= 0").select("slice", "data")))
    total = rows.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / _BUCKET))
    entries = durable(shared_entries(prefix_blocks(docs, words, percent, shared, buckets), buckets, percent))
    parts = durable(rows_with_parts.filter("n > 0").groupBy("c").agg(F.first("seg").alias("seg")))
    best = F.max_by("first", F.struct("shared", -F.col("first")))
    tried = durable(
        entries.filter(F.col("first").isNotNull())
        .groupBy("c", "first").agg(F.count(F.lit(1)).alias("shared"))
        .groupBy("c").agg(best.alias("first"))
        .select(F.least("c", "first").alias("a"), F.greatest("c", "first").alias("b"))
        .distinct()
    )
    links = check_pairs(docs, tried, parts, words, percent)
    roots = components(links)
    more = durable(cross_pairs(entries, roots, tried, percent))
    if not more.isEmpty():
        links = links.unionAll(check_pairs(docs, more, parts, words, percent))
        roots = components(links)
    classes = rows.filter("n > 0").groupBy("c").agg(F.min("k").alias("least"))
    placed = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("c", "component_id")
    full = rows.filter("n > 0").join(named, "c").select("k", "n", "component_id")
    empty = rows.filter("n = 0").select("k", "n", F.col("k").alias("component_id"))
    return full.unionAll(empty).select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def check_pairs(docs: DataFrame, pairs: DataFrame, parts: DataFrame, words: int, percent: int) -> DataFrame:
    """The linked pairs: suffix filter first, then the sets of the classes that are left."""
    left = durable(possible_pairs(pairs, parts, percent))
    classes = left.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    return durable(verified(left, class_sets(docs, classes, words), percent))
