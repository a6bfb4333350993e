"""Packing of token pieces by minimum bin slack.

Documents are tokenized once and cut at the window size. What is packed is the
histogram of piece lengths, at most one number per length: for the longest length
left, a subset-sum table over bit sets finds the multiset of remaining lengths that
fills the window closest to capacity, and the found pattern is used as often as the
counts allow. Pieces then look up their place from their rank among the pieces of
their length, so no task sees all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.ordered import position_in_group
from cladeframe.llm.common import durable, id_type, release, tokenizer_path
from cladeframe.llm.words import memory, slices

#: One item of a pattern: length, pieces of it per window, offset of the first, rank of its first piece.
Item = tuple[int, int, int, int]


def token_pieces(
    df: DataFrame, id_col: str, text_col: str, path: str, end_id: int, window: int, with_ids: bool
) -> DataFrame:
    """Rows (k, start, length, ids_crc32, doc_tokens[, ids]): windows of every document's ids."""

    names = ["k", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32())]
    kind = pa.schema(list(zip(names, kinds, strict=True))[: 6 if with_ids else 5])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = memory(path, byte_level=False)
        for batch in batches:
            for keys, texts in slices(batch):
                rows: list[tuple] = []
                for key, text_ids in zip(keys, coder.encode(texts), strict=True):
                    ids = np.append(text_ids, np.uint32(end_id)).astype("<u4")
                    for a in range(0, len(ids), window):
                        part = ids[a : a + window]
                        made = (key, a, len(part), zlib.crc32(part.tobytes()), len(ids))
                        rows.append((*made, part.astype(np.int32)) if with_ids else made)
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)
            del batch
            release()
        release()

    schema = "k string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    if with_ids:
        schema += ", ids array<int>"
    made = df.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)
    return made.withColumn("k", F.col("k").cast(id_type(df, id_col)))


def best_fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The pattern for the longest length left: it and the multiset that leaves least padding.

    A window filled to a power of two is not padded, so without an exact fill such
    a sum is taken before the sum closest to capacity.
    """
    longest = max(counts)
    target = window - longest
    left = {**counts, longest: counts[longest] - 1}
    full = 1 << target
    mask = (full << 1) - 1
    reach, steps = 1, []
    for length in sorted((x for x, n in left.items() if n and x <= target), reverse=True):
        many = min(left[length], target // length)
        steps.append((length, many, reach))
        batch = 1
        while many:  # binary splitting of the multiplicity
            take = min(batch, many)
            reach |= (reach << (take * length)) & mask
            many -= take
            batch *= 2
        if reach & full:
            break
    if reach & full:
        total = target
    else:
        total = reach.bit_length() - 1
        power = 1 << (window.bit_length() - 1)
        while power >= longest:
            if power - longest <= target and reach >> (power - longest) & 1:
                total = power - longest
                break
            power >>= 1
    pattern = {longest: 1}
    for length, many, before in reversed(steps):
        take = 0
        while take <= many and not (total >= take * length and before >> (total - take * length) & 1):
            take += 1
        if take:
            pattern[length] = pattern.get(length, 0) + take
            total -= take * length
    return pattern


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, list[Item]]]:
    """Patterns (first window, windows, items); every step uses up at least one length."""
    counts = {int(x): int(n) for x, n in histogram.items() if n}
    given = dict.fromkeys(counts, 0)
    out, windows = [], 0
    while counts:
        pattern = best_fill(counts, window)
        uses = min(counts[x] // n for x, n in pattern.items())
        items, offset = [], 0
        for length, many in pattern.items():
            items.append((length, many, offset, given[length]))
            offset += length * many
            given[length] += many * uses
            counts[length] -= many * uses
            if not counts[length]:
                del counts[length]
        out.append((windows, uses, items))
        windows += uses
    return out


def place(pieces: DataFrame, window: int, key: str = "k") -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of 1 to ``window``."""
    rows = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``window`` rows
    histogram = {r["length"]: r["n"] for r in rows}
    most = max(1, sum(histogram.values()) // 1_000)
    order = [key, "start", "doc_tokens", "ids_crc32"]
    spread = F.pmod(F.xxhash64(*order), F.lit(most))
    ranked = position_in_group(pieces, ["length"], order, spread, "rank")
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for first, _, items in plan(histogram, window):
        for length, many, offset, rank in items:
            by_length.setdefault(length, []).append((rank, first, many, offset))
    table = {x: np.array(sorted(rows), np.int64) for x, rows in by_length.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # a few numbers per pattern, at most ``window`` lengths

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence = np.zeros(len(batch), np.int64)
            offset = np.zeros(len(batch), np.int64)
            rank = batch["rank"].to_numpy()
            for length, at in batch.groupby("length").indices.items():
                known = shared.value[length]
                row = known[np.searchsorted(known[:, 0], rank[at], "right") - 1]
                within = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + within // row[:, 2]
                offset[at] = row[:, 3] + within % row[:, 2] * length
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    kind = id_type(pieces, key)
    schema = ", ".join(f"{f.name} {'string' if f.name == key else f.dataType.simpleString()}" for f in pieces.schema.fields)
    rows = ranked.select(*pieces.columns, "rank").withColumn(key, F.col(key).cast("string"))
    placed = rows.mapInPandas(run, f"{schema}, sequence_id bigint, offset bigint")
    return placed.withColumn(key, F.col(key).cast(kind))


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    window: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A null or empty text is the single id ``end_id``. A null id stays null; repeated
    rows are packed as often as they occur; an empty table gives no rows; other
    columns are not read whatever their names. ``tokenizer`` is the path of a
    tokenizer file that drops white space.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    pieces = durable(token_pieces(df, id_col, text_col, path, end_id, window, with_ids))
    return place(pieces, window).withColumnRenamed("k", id_col)
