"""License scans as an exact set-similarity join of text blocks with templates.

A block matches a template when it holds at least ``threshold`` of the template's
distinct words. Blocks are the lines of a text and, for notices wrapped over lines,
all windows of up to 1/threshold times the template's words. Template words are
ordered by their document frequency over the whole table, rarest first. A matching
block must hold one of the first ``|T| - need + 1`` of them, so only texts with such
a word are cut into blocks; length and positional bounds come before the full count.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import id_type

#: Phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices in common use (fixed values); callers may pass their own.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("cc-by", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Everything but 0-9, A-Z, a-z and non-ASCII bytes becomes a blank; A-Z become a-z.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def _frequencies(df: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Document frequency over the whole table of the template words (a bounded set)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch["t"]:
                if t:
                    total.update(vocabulary.intersection(words(t.encode("utf-8", "replace"))))
        yield pd.DataFrame({"w": [w.decode() for w in total], "n": list(total.values())}).astype({"w": object, "n": "int64"})

    rows = df.mapInPandas(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {r["w"].encode(): r["n"] for r in rows}


class TemplateIndex:
    """Templates with their words in frequency order and an index of the prefixes."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], frequency: dict[bytes, int], threshold: float):
        self.width = [math.floor(len(t) / max(threshold, 1e-9) + 1e-9) for _, t in templates]
        templates = [(label, frozenset(t)) for label, t in templates]
        rank = sorted({w for _, t in templates for w in t}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(rank)}
        self.templates = [(label, sorted(t, key=self.rank.__getitem__)) for label, t in templates]
        self.need = [max(1, math.ceil(threshold * len(t) - 1e-9)) for _, t in self.templates]
        self.prefix: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.templates):
            for i, w in enumerate(t[: len(t) - self.need[k] + 1]):
                self.prefix[w].append((k, i))
        self.words = frozenset(self.prefix)

    def matches(self, block: frozenset[bytes]) -> list[tuple[int, float]]:
        """Number and containment of every template that the block holds."""
        out, seen = [], set()
        own = sorted(self.rank.keys() & block, key=self.rank.__getitem__)
        for j, w in enumerate(own):
            for k, i in self.prefix.get(w, ()):
                need = self.need[k]
                if k in seen:
                    continue
                seen.add(k)  # the first shared prefix word decides: one verification per pair
                t = self.templates[k][1]
                if len(block) < need or min(len(t) - i, len(own) - j) < need:
                    continue
                shared = sum(x in block for x in t[i:])
                if shared >= need:
                    out.append((k, shared / len(t)))
        return out

    def windows(self, ws: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """Number, first and last word, containment of the windows that hold a template; those of one template do not overlap."""
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(ws):
            if w in self.rank:
                at[w].append(i)
        for k in sorted({k for w in self.words & at.keys() for k, _ in self.prefix[w]}):
            t, need = self.templates[k][1], self.need[k]
            if sum(w in at for w in t) < need:
                continue
            # a window holds a prefix word: nothing farther from one than the width counts
            rare = sorted(i for w in t[: len(t) - need + 1] for i in at.get(w, ()))
            own = sorted((i, w) for w in t for i in at.get(w, ()))
            held: Counter[bytes] = Counter()
            good, left, near = [], 0, 0
            for i, w in own:
                held[w] += 1
                while i - own[left][0] >= self.width[k] or held[own[left][1]] > 1:
                    held[own[left][1]] -= 1
                    if not held[own[left][1]]:
                        del held[own[left][1]]
                    left += 1
                while near + 1 < len(rare) and rare[near + 1] <= i:
                    near += 1
                if rare[near] <= i and rare[near] >= own[left][0] and len(held) >= need:
                    good.append((-len(held), own[left][0], i))
            taken: list[tuple[int, int]] = []
            for n, a, b in sorted(good):
                j = bisect_left(taken, (a, b))
                if (j == 0 or taken[j - 1][1] < a) and (j == len(taken) or taken[j][0] > b):
                    taken.insert(j, (a, b))
                    yield k, a, b, -n / len(t)


def _blocks(index: TemplateIndex, raw: bytes) -> list[dict]:
    """Lines that match, and windows over several lines that hold more of a template than each of these lines."""
    lines = [words(x) for x in raw.split(b"\n")]
    found = [(i, k, c) for i, x in enumerate(lines) if x for k, c in index.matches(frozenset(x))]
    alone = {(i, k): c for i, k, c in found}
    ends = list(accumulate(map(len, lines)))
    for k, a, b, c in index.windows([w for x in lines for w in x]):
        first, last = bisect_right(ends, a), bisect_right(ends, b)
        if first < last and all(alone.get((i, k), 0.0) < c for i in range(first, last + 1)):
            found.append((first, k, c))
    return [{"line": i, "label": index.templates[k][0], "containment": c} for i, k, c in sorted(found)]


def _places(ws: list[bytes], phrases: list[tuple[tuple[bytes, ...], str]], first: frozenset[bytes]) -> list[tuple[int, str]]:
    if first.isdisjoint(ws):
        return []
    found = []
    for i, w in enumerate(ws):
        if w in first:
            found += [(i, label) for p, label in phrases if tuple(ws[i : i + len(p)]) == p]
    return found


def license_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    phrases: dict[str, str] | None = None,
    threshold: float = 0.85,
) -> DataFrame:
    """One row per input row: n_words, ``places`` of the phrases and ``blocks`` that match templates.

    ``places`` holds (word, label), word the start of the phrase counted from 0;
    ``blocks`` holds (line, label, containment), line the first one of the block, counted from 0.

    A null or empty text has no words, places or blocks. A null id stays null,
    repeated rows give repeated results, an empty table gives no rows, and other
    columns are not read whatever their names.
    """
    sets = [(label, words(t.encode())) for label, t in templates]
    sets = [(label, t) for label, t in sets if t]
    wanted = [(tuple(words(p.encode())), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    first = frozenset(p[0] for p, _ in wanted)
    narrow = df.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"))
    vocabulary = frozenset(w for _, t in sets for w in t)
    index = TemplateIndex(sets, _frequencies(narrow.select("t"), vocabulary), threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, places, blocks = [], [], []
            for t in batch["t"]:
                raw = (t or "").encode("utf-8", "replace")
                ws = words(raw)
                n.append(len(ws))
                places.append([{"word": i, "label": x} for i, x in _places(ws, wanted, first)])
                blocks.append([] if index.words.isdisjoint(ws) else _blocks(index, raw))
            yield pd.DataFrame({"k": batch["k"], "n_words": n, "places": places, "blocks": blocks})

    schema = (
        "k string, n_words bigint, places array<struct<word: bigint, label: string>>, "
        "blocks array<struct<line: bigint, label: string, containment: double>>"
    )
    out = narrow.mapInPandas(run, schema)
    return out.withColumn("k", F.col("k").cast(id_type(df, id_col))).withColumnRenamed("k", id_col)


def license_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, first and last place, labels and the best containment (1 where a phrase stands)."""
    base, more = F.col("places.label"), F.col("blocks.label")
    return found.select(
        id_col,
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )
