"""Importance resampling towards a target: hashed word n-grams, gains of their buckets, Gumbel top-k.

An untrained Regex Split of the tokenizers library cuts the ASCII-lowered text into words
with their offsets. Windows over pairs of offsets are the features: a window's CRC is put
together from those of its words in numpy (CRC is linear, so a CRC moved past ``n`` bytes
is four table look-ups). Corpus and target histograms over the buckets give every bucket
a gain; a document's weight is the sum over its features. The draw adds Gumbel noise
from a digest of the id and takes the highest scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import durable, id_type, release
from cladeframe.llm.words import blocks, spread

#: The characters of a word; the text has no capital A to Z when it is cut.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SHORT = 64
_POLYNOMIAL = 0xEDB88320  # of the CRC-32 of zlib


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


def _move_tables(most: int) -> np.ndarray:
    """Entry [n, i, b]: byte ``b`` at place ``i`` of a CRC after ``n`` zero bytes."""
    byte = _byte_table()
    step = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    out = [step]
    for _ in range(most):
        step = byte[step & 255] ^ step >> 8
        out.append(step)
    return np.stack(out)


_BYTE = _byte_table()
_MOVE = _move_tables(_SHORT).ravel()
_BLANK = np.uint32(zlib.crc32(b" "))


def move(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs moved past ``size`` bytes."""
    crc, size = crc.copy(), size.copy()
    while True:
        now = np.minimum(size, _SHORT)
        base = now * 1024
        crc = (
            _MOVE.take(base + (crc & 255)) ^ _MOVE.take(base + 256 + (crc >> 8 & 255))
            ^ _MOVE.take(base + 512 + (crc >> 16 & 255)) ^ _MOVE.take(base + 768 + (crc >> 24))
        )
        size -= now
        if not size.any():
            return crc


def _crcs(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, a column of bytes at a time; long ranges go to zlib."""
    out = np.full(len(first), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero(size <= _SHORT)
    for column in range(int(size[left].max(initial=0))):
        left = left[size[left] > column]
        state = out[left]
        out[left] = _BYTE.take((state ^ data[first[left] + column]) & 255) ^ state >> 8
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = zlib.crc32(data[first[i] : first[i] + size[i]].tobytes())
    return out


class Windows:
    """Buckets of all windows of 1 to ``longest`` words of texts."""

    def __init__(self, buckets: int, longest: int):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(WORD), "removed", invert=True)
        self.buckets, self.longest = buckets, longest

    def _offsets(self, raw: bytes) -> np.ndarray:
        """Rows (start, end) in bytes of the words of a lowered text."""
        text = raw.decode("utf-8")
        pairs = [pair for _, pair in self.split.pre_tokenize_str(text)] if text else []
        found = np.array(pairs, np.int64).reshape(-1, 2)
        if len(text) == len(raw):
            return found
        starts = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)  # bytes that begin a character
        return np.append(starts, len(raw))[found]

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Number of words of every text, and the buckets of its windows."""
        raws = [(t or "").encode("utf-8", "replace").lower() for t in texts]
        found = [self._offsets(r) for r in raws]
        words = np.array([len(f) for f in found], np.int64)
        shift = np.cumsum([0, *map(len, raws)])[:-1]
        pairs = np.concatenate([f + s for f, s in zip(found, shift.tolist(), strict=True)])
        size = pairs[:, 1] - pairs[:, 0]
        word = _crcs(np.frombuffer(b"".join(raws), np.uint8), pairs[:, 0], size)
        behind = move(np.full(len(word), _BLANK), size) ^ word  # of the word behind a blank
        at = np.cumsum(words) - words
        kinds, window = [word], word
        for length in range(2, self.longest + 1):
            window = move(window[: max(0, len(word) - length + 1)], size[length - 1 :] + 1) ^ behind[length - 1 :]
            kinds.append(window)
        out = [[] for _ in texts]
        for length, crcs in enumerate(kinds, 1):
            bucket = (crcs % np.uint32(self.buckets)).astype(np.uint16 if self.buckets <= 1 << 16 else np.uint32)
            for part, a, n in zip(out, at.tolist(), words.tolist(), strict=True):
                part.append(bucket[a : a + max(0, n - length + 1)])
        return words, [np.concatenate(p) for p in out]


def bucket_rows(df: DataFrame, text_col: str, buckets: int, longest: int, id_col: str | None = None) -> DataFrame:
    """Rows ([k,] n_words, buckets): the buckets of all features of a text, as an array of machine integers."""
    columns = [F.col(text_col).alias("t"), *([F.col(id_col).cast("string").alias("k")] if id_col else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = Windows(buckets, longest)
        for batch in batches:
            texts = batch["t"].tolist()
            for lo, hi in blocks(texts):
                words, found = windows.of(texts[lo:hi])
                out = pd.DataFrame({"n_words": words, "buckets": [f.tobytes() for f in found]})
                yield out.assign(k=batch["k"].iloc[lo:hi].to_numpy()) if id_col else out
        release()

    return df.select(*columns).mapInPandas(run, "n_words bigint, buckets binary" + (", k string" if id_col else ""))


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket; every task adds up its own, and at most ``buckets`` rows come to the driver."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["b", "n"])

    out = np.zeros(buckets, np.int64)
    for row in rows.select("buckets").mapInArrow(run, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[row["b"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share of every bucket over its corpus share."""
    s_all, t_all = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratios = ((float(t) + 1) * s_all / ((float(s) + 1) * t_all) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def importance_resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = 10_000,
    longest: int = 3,
    least_words: int = 20,
    percent: int = 5,
    seed: int = 42,
) -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank.

    Rows with at least ``least_words`` words take part in the draw: ``percent`` of them
    (rounded down) with the highest scores get the ranks 1, 2, 3, ... (ties: the smaller
    id first), the others and all shorter texts a null rank. A null or empty text has no
    features and the weight 0; a null id is noised as an empty one and comes last among
    ties; repeated rows are rows of their own; empty tables are corpora without features;
    other columns are not read whatever their names.
    """
    kind = id_type(df, id_col)
    rows = durable(bucket_rows(df, text_col, buckets, longest, id_col))
    corpus = histogram(rows, buckets)
    aimed = histogram(bucket_rows(target, target_text_col, buckets, longest), buckets)
    gain = df.sparkSession.sparkContext.broadcast(gains(corpus, aimed))  # one number a bucket
    width = 2 if buckets <= 1 << 16 else 4

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(v.as_buffer(), np.uint16 if width == 2 else np.uint32) for v in batch.column("buckets")]
            weight = pa.array([int(gain.value[f].sum()) for f in found], pa.int64())
            n = pa.array([len(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n_words"), n, weight], ["k", "n_words", "n_features", "weight"])

    weighed = rows.select("k", "n_words", "buckets").mapInArrow(weigh, "k string, n_words bigint, n_features bigint, weight bigint")
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("k", F.lit(""))), 256), 1, 8)
    share = (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("bigint")
    scored = weighed.select(F.col("k").cast(kind).alias("k"), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    # ranges of the order become partitions; a row's place is its place there and the rows of the ranges before
    drawn = (F.col("n_words") >= least_words).alias("fit")
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("k").asc_nulls_last()]
    ordered = scored.select("*", drawn).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(ordered.withColumn("i", F.monotonically_increasing_id()))
    part = F.shiftright("i", 33)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fit").alias("fit"))
    parts = parts.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), "fit")  # one row a partition
    most = parts.agg(F.floor(F.coalesce(F.sum("fit"), F.lit(0)) * percent / 100).alias("m")).first()["m"]
    place = F.col("offset") + F.col("i").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("p", part).join(F.broadcast(parts.select("p", "offset")), "p").select(
        F.col("k").alias(id_col), "n_features", "weight", "score", F.when(F.col("fit") & (place <= most), place).alias("rank")
    )
