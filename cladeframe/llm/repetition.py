"""Quality rules by repetition coverage.

Every text is read once as bytes. Words get codes, rolling hashes of several
n-gram lengths run over the codes in numpy, and the characters inside repeated
n-grams and lines are summed. Equal hashes are compared word by word, so a clash
of hashes changes nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import id_type

#: Largest share of characters inside repeated n-grams of each length (fixed values).
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters on lines equal to an earlier line (fixed value).
LINE_LIMIT = 0.20
SYMBOLS = b"#*$%&|<>"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_BASES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(codes: np.ndarray, base: np.uint64) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * base
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def repeated_windows(codes: np.ndarray, lengths: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each n: starts of windows equal to an earlier one, and of all windows found twice or more.

    A window can only repeat where its shorter prefix does, so each length hashes
    the starts that the length before it has left.
    """
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    word = _mixed(codes, _BASES[0])
    alive = np.arange(len(codes))
    for n in sorted(lengths):
        alive = alive[alive <= len(codes) - n]
        later, alive = _equal_windows(codes, word, alive, n)
        out[n] = (later, alive)
    return out


def _equal_windows(codes: np.ndarray, word: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    for base in _BASES:
        if len(starts) < 2:
            return starts[:0], starts[:0]
        h = word[starts]
        for j in range(1, n):
            h = h * base + word[starts + j]
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        at = np.flatnonzero(ranked[1:] == ranked[:-1])
        left, right = starts[order[at]], starts[order[at + 1]]
        if not len(at) or all((codes[left + j] == codes[right + j]).all() for j in range(n)):
            both = np.zeros(len(codes), bool)
            both[left] = both[right] = True
            return right, np.flatnonzero(both)
    first: dict[tuple, int] = {}  # every base clashed: compare the windows themselves
    later, both = [], np.zeros(len(codes), bool)
    for i in starts:
        j = first.setdefault(tuple(codes[i : i + n]), i)
        if j != i:
            later.append(i)
            both[[i, j]] = True
    return np.array(later, np.int64), np.flatnonzero(both)


def covered(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words inside the windows of length ``n`` at ``starts``."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None, lengths: list[int]) -> dict:
    raw = (text or "").encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    points = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~space)))
    chars = points[ends] - points[starts]
    n_words = len(starts)
    table: defaultdict[bytes, int] = defaultdict()
    table.default_factory = table.__len__
    codes = np.array(list(map(table.__getitem__, raw.split())), np.int64)
    found = repeated_windows(codes, sorted({3, *lengths}))
    total = int(chars.sum())
    lines, n_dup, dup_chars = set(), 0, 0
    for line in raw.split(b"\n"):
        if line in lines:
            n_dup += 1
            dup_chars += sum(len(w.decode("utf-8")) for w in line.split())
        elif line.strip(b"\t\n\x0b\x0c\r "):
            lines.add(line)
    row = {
        "n_words": n_words,
        "word_chars": total,
        "n_symbols": int(_SYMBOL[data].sum()),
        "n_dup_lines": n_dup,
        "n_repeat_words": int(covered(found[3][1], 3, n_words).sum()) if len(found[3][1]) else 0,
        "dup_line_share": dup_chars / total if total else 0.0,
    }
    for n in lengths:
        later = found[n][0]
        row[f"dup_{n}gram_share"] = float(chars[covered(later, n, n_words)].sum() / total) if len(later) else 0.0
    return row


def repetition_coverage(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: dict[int, float] | None = None,
    line_limit: float = LINE_LIMIT,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """One row per input row: counts, shares and a verdict.

    ``dup_<n>gram_share`` is the share of word characters (code points) inside
    n-grams equal to an earlier one, ``dup_line_share`` inside lines equal to an
    earlier one. ``base_failed`` is the plain rule; ``kept`` is false if it fails
    or if any share exceeds its limit.

    Null and empty texts have no words: all counts 0, base_failed. A null id is
    kept as it is; repeated rows give repeated results; other columns of the input
    are not read, whatever their names. An empty table gives no rows.
    """
    limits = dict(LIMITS if limits is None else limits)
    lengths = sorted(limits)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["dup_line_share", *(f"dup_{n}gram_share" for n in lengths)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [measure(t, lengths) for t in batch["t"]]
            out = pd.DataFrame({c: [r[c] for r in rows] for c in (*counts, *shares)})
            out.insert(0, "k", batch["k"].to_numpy())
            yield out

    schema = "k string, " + ", ".join([f"{c} bigint" for c in counts] + [f"{c} double" for c in shares])
    measured = df.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).mapInPandas(run, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    good = F.col("dup_line_share") <= line_limit
    for n, most in limits.items():
        good = good & (F.col(f"dup_{n}gram_share") <= most)
    return measured.select(
        F.col("k").cast(id_type(df, id_col)).alias(id_col), *counts, failed.alias("base_failed"), (~failed & good).alias("kept"), *shares
    )
