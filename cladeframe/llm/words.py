"""Token ids of whole texts through a memory of their words.

A tokenizer that cuts a text at certain places before it merges gives the ids of the
parts one after another, so a part has to be encoded once only. The parts are found
and named in numpy: a block of texts is one byte array, white space cuts it, and every
part gets two 64-bit hashes (one to look it up, one to check it). A worker keeps the
parts it has met from task to task as sorted hashes and one flat array of ids. The
memory is bounded in bytes: at its limit the parts that were met again since the last
turn stay, the others go.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: The only white space of ASCII; \x1c to \x1f are none to the tokenizers.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits, and what is neither these nor white space.
_WORDLY = np.array([chr(b).isalnum() for b in range(128)] + [False] * 128)
_MARK = ~_WORDLY & ~_SPACE
_MARK[128:] = False
#: White space beyond ASCII: such a text is not cut here but encoded as a whole.
_WIDE_SPACE = re.compile(r"[^\S\x00-\x7f]")
#: Longer parts are encoded whenever they come.
_LONGEST = 255
_ROW = 64
#: Bytes of a remembered part besides its ids.
_ENTRY = 41


#: Bytes 0 to 7 of a value, and what keeps the first n of them.
_EIGHT = 8
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(_EIGHT + 1)], np.uint64)


def _powers(base: int) -> np.ndarray:
    out = [1]
    for _ in range(_LONGEST // _EIGHT):
        out.append(out[-1] * base % (1 << 64))
    return np.array(out, np.uint64)


#: For each of the two hashes: what is added a byte and multiplied with, odd, and the factors by place.
_LENGTHS = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]
_FACTORS = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]
_PLACES = [_powers(base) for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (size[i] of them) for every i in turn."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat(first - ends + size, size)
    out += np.arange(total)
    return out


def _hashes(raw: bytes, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every part of at most ``_LONGEST`` bytes: eight bytes of a part at a time are
    mixed with their number and added up by place."""
    padded = np.frombuffer(raw + bytes(_EIGHT), np.uint8)
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from every byte on
    out = np.zeros((2, len(first)), np.uint64)
    rows: np.ndarray | slice = slice(None)  # parts that reach the place
    at, left = first, size
    for place in range(-(-int(size.max(initial=0)) // _EIGHT)):
        if place:
            more = np.flatnonzero(left > _EIGHT)
            rows = more if place == 1 else rows[more]
            at, left = at[more] + _EIGHT, left[more] - _EIGHT
        held = np.minimum(left, _EIGHT)
        value = eights[at] & _FIRST.take(held)
        held = held.astype(np.uint64)
        for i in (0, 1):
            mixed = (value + held * _LENGTHS[i]) * _FACTORS[i]
            mixed ^= mixed >> np.uint64(32)
            mixed *= _FACTORS[1 - i]
            mixed ^= mixed >> np.uint64(29)
            mixed *= _PLACES[i][place]
            out[i, rows] += mixed
    return out[0], out[1]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in ascending order, a place of each, and the number of the key of every place."""
    of, found = pd.factorize(keys)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    of = rank.take(of)
    one = np.empty(len(order), np.int64)
    one[of] = np.arange(len(of))
    return found[order], one, of


def _longer(x: np.ndarray) -> np.ndarray:
    """Twice as long; what is not written yet takes no memory."""
    out = np.zeros(2 * len(x), x.dtype)
    out[: len(x)] = x
    return out


class WordMemory:
    """Ids of texts; ``byte_level`` tells a byte-level pattern (white space belongs to the word behind
    it, marks behind a letter or digit are a part of their own) from a tokenizer that drops white space."""

    def __init__(self, path: str, byte_level: bool, most_bytes: int = 96 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        resize = getattr(self.tokenizer.model, "_resize_cache", None)
        if resize is not None:  # every part is encoded once, so the model's own memory only costs
            resize(0)
        self.byte_level = byte_level
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special and byte_level else None
        self.most_bytes = most_bytes
        if byte_level:  # ids that begin with a blank or a line feed
            vocabulary = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[i for t, i in vocabulary.items() if t[:1] in "ĠĊ"]] = True
        else:
            (self.bar,) = self.tokenizer.encode("|", add_special_tokens=False).ids
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.checks = np.zeros(0, np.uint64)
        self.codes = np.zeros(0, np.int64)  # the part's place in first, size and again
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.count = self.used = 0

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and their number by text, every text encoded by itself."""
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(ids) for ids in coded], np.int64)
        return np.fromiter((i for ids in coded for i in ids), np.uint32, int(sizes.sum())), sizes

    def _in_row(self, words: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words from the ids of all of them in a row."""
        if self.byte_level:
            starts = np.flatnonzero(self.opens[ids])
            sizes = np.diff(np.append(starts, len(ids)))
        else:
            bars = np.flatnonzero(ids == self.bar)
            sizes = np.diff(np.concatenate(([-1], bars, [len(ids)]))) - 1
            ids = np.delete(ids, bars)
        if len(sizes) == len(words) and sizes.sum() == len(ids):
            return ids, sizes
        return self._whole([w.decode("utf-8", "replace") for w in words])

    def _encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that were not met before: plain ones in rows of some dozens, which are told apart again."""
        if self.byte_level:
            plain = [w[:1] in (b" ", b"\n") and w[1:2] > b" " for w in words]
        else:
            plain = [b"|" not in w for w in words]  # every special token has one
        rowed = list(compress(words, plain))
        rest = [w.decode("utf-8", "replace") for w, p in zip(words, plain, strict=True) if not p]
        rows = [rowed[a : a + _ROW] for a in range(0, len(rowed), _ROW)]
        texts = [(b"" if self.byte_level else b" | ").join(r).decode("utf-8", "replace") for r in rows]
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        parts = [self._in_row(r, np.array(e.ids, np.uint32)) for r, e in zip(rows, coded, strict=True)]
        parts.append(self._whole(rest))
        ids, sizes = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        place = np.array(plain, bool)
        order = np.empty(len(words), np.int64)  # where the ids of every word stand
        order[place] = np.arange(len(rowed))
        order[~place] = len(rowed) + np.arange(len(rest))
        first = np.cumsum(sizes) - sizes
        return ids[spread(first[order], sizes[order])], sizes[order]

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        codes = self.count + np.arange(len(sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = _longer(self.flat)
        while self.count + len(sizes) > len(self.first):
            self.first, self.size, self.again = map(_longer, (self.first, self.size, self.again))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[codes] = sizes
        self.first[codes] = self.used + np.cumsum(sizes) - sizes
        self.again[codes] = False
        self.used += len(ids)
        self.count += len(sizes)
        return codes

    def _turn(self) -> None:
        """Forget the parts that were not met again, or all where the others fill half of the memory."""
        kept = self.again[self.codes]
        codes = self.codes[kept]
        if 2 * (len(codes) * _ENTRY + 4 * int(self.size[codes].sum())) > self.most_bytes:
            kept, codes = np.zeros(len(kept), bool), codes[:0]
        keys, checks = self.keys[kept], self.checks[kept]
        ids, sizes = self._ids(codes), self.size[codes]
        self._empty()
        self.keys, self.checks, self.codes = keys, checks, self._store(ids, sizes)

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.first[codes], self.size[codes])]

    def _cut(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and size of every part; ``edges`` are the first bytes of the texts that hold any."""
        space = _SPACE.take(data)
        after = np.empty(len(space), bool)  # behind white space or the start of a text
        after[1:] = space[:-1]
        if self.byte_level:
            begin = space & ~after
            begin[1:] |= _MARK.take(data[1:]) & _WORDLY.take(data[:-1])
            begin[edges] = True
            first = np.flatnonzero(begin)
            return first, np.diff(np.append(first, len(data)))
        after[edges] = True
        first = np.flatnonzero(~space & after)
        stop = np.zeros(len(space) + 1, bool)
        stop[:-1] = space
        stop[edges] = True
        stop[-1] = True
        stop[1:] &= ~space
        stop[0] = False
        return first, np.flatnonzero(stop) - first

    def _uncut(self, text: str) -> bool:
        """Whether a text holds white space beyond ASCII or a special token, which may not be cut."""
        if not text.isascii() and _WIDE_SPACE.search(text):
            return True
        return self.special is not None and self.special.search(text) is not None

    def _look_up(self, raw: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The codes of the parts; new ones are learnt."""
        if not len(first):
            return np.zeros(0, np.int64)
        key, check = _hashes(raw, first, size)
        key, one, of = _distinct(key)
        mine = check[one]
        wrong = mine[of] != check  # parts of one hash that are not the same
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[inside]
        codes = np.zeros(len(key), np.int64)
        codes[known] = self.codes[at[known]]
        self.again[codes[known]] = True
        strange = np.zeros(len(key), bool)
        strange[known] = self.checks[at[known]] != mine[known]
        new = np.flatnonzero(~known)
        if len(new):
            words = [raw[a : a + n] for a, n in zip(first[one[new]].tolist(), size[one[new]].tolist(), strict=True)]
            codes[new] = self._store(*self._encode_new(words))
            self.keys = np.insert(self.keys, at[new], key[new])
            self.checks = np.insert(self.checks, at[new], mine[new])
            self.codes = np.insert(self.codes, at[new], codes[new])
        out = codes[of]
        apart = np.flatnonzero(wrong | strange[of])
        if len(apart):
            out[apart] = self._aside(raw, first[apart], size[apart])
        return out

    def _aside(self, raw: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Codes of parts that are stored without a name."""
        words = [raw[a : a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)]
        return self._store(*self._encode_new(words))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of every text of a block."""
        if self.count * _ENTRY + 4 * self.used > self.most_bytes:
            self._turn()
        wide = [bool(t) and self._uncut(t) for t in texts]
        given = [b"" if not t or w else t.encode("utf-8", "replace") for t, w in zip(texts, wide, strict=True)]
        raw = b"".join(given)
        data = np.frombuffer(raw, np.uint8)
        lengths = np.array([len(g) for g in given], np.int64)
        ends = np.cumsum(lengths)
        first, size = self._cut(data, (ends - lengths)[lengths > 0]) if raw else (ends[:0], ends[:0])
        codes = np.zeros(len(first), np.int64)
        short = size <= _LONGEST
        codes[short] = self._look_up(raw, first[short], size[short])
        if not short.all():
            codes[~short] = self._aside(raw, first[~short], size[~short])
        ids, sizes = self._ids(codes), self.size[codes]
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(first, np.concatenate(([0], ends)))]
        for i, (text, a, b) in enumerate(zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            yield self._whole([text])[0] if wide[i] else ids[a:b]


_KEPT: dict[tuple[str, bool], WordMemory] = {}


def memory(path: str, *, byte_level: bool) -> WordMemory:
    """The worker's memory of a tokenizer file; it lives on from task to task."""
    if (path, byte_level) not in _KEPT:
        _KEPT.clear()  # one at a time
        _KEPT[path, byte_level] = WordMemory(path, byte_level)
    return _KEPT[path, byte_level]


def blocks(texts: list, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def slices(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[tuple[list, list]]:
    """Keys and texts (columns k and t) of a batch by parts of about ``most`` characters: only a part is Python strings at once."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        last = min(int(np.searchsorted(ends, done + most)) + 1, batch.num_rows)
        part = batch.slice(first, last - first)
        yield part.column("k").to_pylist(), part.column("t").to_pylist()
        first = last
