"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to ``order`` bytes, learned from a
bounded sample of labelled texts and then frozen. A byte costs -log2 c/(n+q) in the
longest context of a language that has seen it before (c its count, n all counts, q
distinct bytes); every longer context that the language knows costs an escape,
-log2 q/(n+q). A byte that a language has never seen costs 8 bits more. The language
with the shortest code of the whole text is predicted.

The trees of all languages share one key table per order, so a text is scored by
array lookups: one for most bytes, more for the few that need an escape.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import release

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3)]
_CHUNK = 1 << 18  # bytes scored at once


def padded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, ``order`` zero bytes before each; starts and lengths of the texts."""
    gap = b"\0" * order
    data = np.frombuffer(gap + gap.join(texts) + b"\0" * 8, np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.concatenate(([0], lengths[:-1]))) + order * np.arange(1, len(texts) + 1)
    return data, starts, lengths


def grams(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` bytes that end at each position, as one number."""
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return view[at - (n - 1)] & np.uint64((1 << (8 * n)) - 1)


class KeyTable:
    """Place of a key in a sorted array, -1 if absent; levels of hash slots, each as large as its keys need, take the clashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.levels: list[np.ndarray] = []
        left = np.arange(len(keys), dtype=np.int32)
        for mult in _MULTIPLIERS:
            table = np.full(1 << max(10, int(np.ceil(np.log2(max(len(left), 1) * 8)))), -1, np.int32)
            slot = self._slot(keys[left], mult, table)
            table[slot] = left
            self.levels.append(table)
            left = left[table[slot] != left]
            if not len(left):
                break
        self.rest = left
        self.used = self.levels[0] >= 0

    @staticmethod
    def _slot(keys: np.ndarray, mult: np.uint64, table: np.ndarray) -> np.ndarray:
        return ((keys * mult) >> np.uint64(65 - len(table).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        out = self.levels[0][self._slot(keys, _MULTIPLIERS[0], self.levels[0])]
        held = np.flatnonzero(out >= 0)  # a key whose slot is empty is absent
        wrong = held[self.keys[out[held]] != keys[held]]
        out[wrong] = self._deeper(keys[wrong])
        return out

    def _deeper(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys that have clashed with others."""
        out, wrong = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for mult, table in zip(_MULTIPLIERS[1:], self.levels[1:], strict=False):
            got = table[self._slot(keys[wrong], mult, table)]
            wrong, got = wrong[got >= 0], got[got >= 0]
            hit = self.keys[got] == keys[wrong]
            out[wrong[hit]] = got[hit]
            wrong = wrong[~hit]
        if len(self.rest):
            known = self.keys[self.rest]
            place = np.minimum(np.searchsorted(known, keys[wrong]), len(known) - 1)
            hit = known[place] == keys[wrong]
            out[wrong[hit]] = self.rest[place[hit]]
        return out

    def find_few(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of the keys that are present, and their places; for keys that are mostly absent."""
        slot = self._slot(keys, _MULTIPLIERS[0], self.levels[0])
        at = np.flatnonzero(self.used.take(slot))
        out, known = self.levels[0][slot[at]], keys[at]
        wrong = np.flatnonzero(self.keys[out] != known)
        out[wrong] = self._deeper(known[wrong])
        hit = out >= 0
        return at[hit], out[hit]


class ContextTrees:
    """Frozen statistics of all languages."""

    def __init__(self, samples: dict[str, list[bytes]], order: int):
        self.languages = sorted(samples)
        self.order = order
        n_lang = len(self.languages)
        counted = []  # per language and order: keys and counts
        for lang in self.languages:
            data, starts, lengths = padded(samples[lang], order)
            at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            counted.append([np.unique(grams(data, at, k + 1), return_counts=True) for k in range(order + 1)])
        self.tables: list[KeyTable] = []
        self.cost: list[np.ndarray] = []  # bits of a key, by language
        self.contexts: list[KeyTable] = []
        self.escape: list[np.ndarray] = []  # bits of leaving a context, by language
        for k in range(order + 1):
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(c[k][0] for c in counted)]))
            context = keys & np.uint64((1 << (8 * k)) - 1)
            contexts, where = np.unique(context, return_inverse=True)
            cost = np.zeros((len(keys), n_lang), np.float32)
            leave = np.zeros((len(contexts), n_lang))
            if k:
                low = self._bits(k - 1, keys >> np.uint64(8), context)
            else:
                low = np.full((len(keys), n_lang), 8.0)
            for j in range(n_lang):
                own_keys, own_counts = counted[j][k]
                count = np.zeros(len(keys))
                count[np.searchsorted(keys, own_keys)] = own_counts
                total = np.bincount(where, count, len(contexts))
                kinds = np.bincount(where, count > 0, len(contexts))
                all_ = total + kinds
                leave[:, j] = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(all_, 1)), 0.0)
                seen = -np.log2(np.maximum(count, 1) / np.maximum(all_[where], 1))
                cost[:, j] = np.where(count > 0, seen, leave[where, j] + low[:, j])
            self.tables.append(KeyTable(keys))
            self.cost.append(cost)
            self.contexts.append(KeyTable(contexts))
            self.escape.append(leave.astype(np.float32))
        self.root = self.escape[0][0].astype(np.float64) if len(self.escape[0]) else np.zeros(n_lang)

    def _bits(self, k: int, keys: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Cost of keys of order ``k``, absent ones by escapes to the orders below."""
        out = np.zeros((len(keys), len(self.languages)), np.float64)
        at = np.arange(len(keys))
        while True:
            place = self.tables[k].find(keys[at])
            hit = place >= 0
            out[at[hit]] += self.cost[k][place[hit]]
            at = at[~hit]
            if not len(at):
                return out
            if k == 0:
                out[at] += self.root + 8.0
                return out
            known = self.contexts[k].find(keys[at] & np.uint64((1 << (8 * k)) - 1))
            out[at[known >= 0]] += self.escape[k][known[known >= 0]]
            keys = keys >> np.uint64(8)
            k -= 1

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text under every language."""
        out = np.zeros((len(texts), len(self.languages)))
        first = 0
        while first < len(texts):
            size, last = 0, first
            while last < len(texts) and (size == 0 or size + len(texts[last]) <= _CHUNK):
                size += len(texts[last])
                last += 1
            out[first:last] = self._score(texts[first:last])
            first = last
        return out

    def _score(self, texts: list[bytes]) -> np.ndarray:
        data, starts, lengths = padded(texts, self.order)
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(lengths)
        if not len(full):
            return out
        starts, lengths = starts[full], lengths[full]
        edge = np.concatenate(([0], np.cumsum(lengths)))
        for a in range(0, int(edge[-1]), _CHUNK):  # a long text goes in slices
            b = min(a + _CHUNK, int(edge[-1]))
            lo, hi = np.searchsorted(edge, a, "right") - 1, np.searchsorted(edge, b, "left")
            cut = np.clip(edge[lo : hi + 1], a, b)
            part = np.diff(cut)
            at = np.repeat(starts[lo:hi] - edge[lo:hi], part) + np.arange(a, b)
            bits = self._bits_at(grams(data, at, self.order + 1))
            out[full[lo:hi]] += np.add.reduceat(bits, cut[:-1] - a, axis=0)
        return out

    def _bits_at(self, keys: np.ndarray) -> np.ndarray:
        place = self.tables[self.order].find(keys)
        bits = self.cost[self.order][place].astype(np.float64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            bits[missing] = self._escaped(keys[missing])
        return bits

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        k = self.order
        if k == 0:
            return np.tile(self.root + 8.0, (len(keys), 1))
        out = np.zeros((len(keys), len(self.languages)))
        known = self.contexts[k].find(keys & np.uint64((1 << (8 * k)) - 1))
        out[known >= 0] += self.escape[k][known[known >= 0]]
        return out + self._bits(k - 1, keys >> np.uint64(8), keys)


def remainder(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def learn(
    df: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int = 256, order: int = 4
) -> ContextTrees:
    """Context trees from whole texts of about ``docs_per_language`` labelled rows of each language.

    The rows are those with the smallest hash of their id, so that the sample does
    not depend on partitions; rows whose crc32 remainder is 2 never take part.
    """
    usable = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(id_col) != 2))
    usable = usable.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return ContextTrees({}, order)
    grain = 1 << 30
    most = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, docs_per_language / n) * grain))])
    drawn = usable.filter(F.pmod(F.xxhash64(F.coalesce("k", F.lit("")), F.lit("ppm")), F.lit(grain)) < most[F.col("l")])
    samples: dict[str, list[bytes]] = {}
    for r in drawn.select("l", "t").collect():
        samples.setdefault(r["l"], []).append(r["t"].encode("utf-8", "replace"))
    return ContextTrees({lang: sorted(t) for lang, t in samples.items()}, order)


def identify_language(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = 256,
    order: int = 4,
    trees: ContextTrees | None = None,
) -> DataFrame:
    """All columns of the input and held_out, lang_pred, score and bits_per_byte.

    ``score`` is the probability of the predicted language if all were equally
    likely before. The prediction reads the text alone; the label column only
    feeds ``learn``.

    A null text, one without letters, and any text when nothing was learned give
    ``und`` with score 0 and null bits_per_byte. Equal code lengths: the first
    language by name. A null id counts as empty text for the split; repeated rows
    give repeated results; an empty table gives no rows. Input columns with the
    names of the added ones are replaced.
    """
    trees = learn(df, id_col, text_col, lang_col, docs_per_language, order) if trees is None else trees
    shared = df.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    @F.arrow_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for part in parts:
            preds, scores, rates = [np.zeros(0, object)], [np.zeros(0)], [np.zeros(0)]
            for lo in range(0, len(part), 256):  # never a whole batch of texts as Python strings at once
                texts = part.slice(lo, 256).to_pylist()
                fit = [t is not None and any(c.isalpha() for c in t) and bool(model.languages) for t in texts]
                at = np.flatnonzero(fit)
                pred = np.full(len(texts), "und", object)
                score, rate = np.zeros(len(texts)), np.full(len(texts), np.nan)
                if len(at):
                    raw = [texts[i].encode("utf-8", "replace") for i in at]
                    bits = model.code_lengths(raw)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(at)), best]
                    pred[at] = np.array(model.languages, object)[best]
                    score[at] = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
                    rate[at] = least / np.array([len(r) for r in raw])
                preds.append(pred)
                scores.append(score)
                rates.append(rate)
            columns = [pa.array(np.concatenate(preds), pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rates))]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score", "bits_per_byte"])
            del part
            release()

    predict = predict.asNondeterministic()  # a filter on a prediction above must not make Spark predict twice, in two workers a task
    added = ["held_out", "lang_pred", "score", "bits_per_byte"]
    own = [c for c in df.columns if c not in added]
    rate = F.col("_said")["bits_per_byte"]
    return df.withColumn("_said", predict(F.col(text_col))).select(
        *own,
        (remainder(id_col) == 2).alias("held_out"),
        F.col("_said")["lang_pred"].alias("lang_pred"),
        F.col("_said")["score"].alias("score"),
        F.when(~F.isnan(rate), rate).alias("bits_per_byte"),
    )
