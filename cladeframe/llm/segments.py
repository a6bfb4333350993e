"""Distinct sampled segmentations of texts into SentencePiece pieces.

A text is a chain of units (a run of spaces and what follows it, or a line break);
no piece crosses units, so the lattice of a text is the chain of its units' lattices.
Gumbel top-k without replacement: the root of the tree of all segmentations draws a
Gumbel value; a node hands its value to one child, drawn by its mass, and every
other child draws a value below it (a Gumbel truncated at the parent's value). Best
first, the k largest leaves are k distinct samples. As a node's value is the largest
of its leaves', the search never backtracks: it walks one path per sample and keeps
the siblings it passes. All texts of a block take each step together in numpy.

Every draw is a hash of the row key, the sample and the place in the text, so the
result does not depend on partitions or reruns.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import id_type, tokenizer_path
from cladeframe.llm.language import KeyTable
from cladeframe.llm.words import slices

_SPACE = "▁"
_UNIT = re.compile(f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n")
#: Siblings of steps whose path has a mass below e^-40 are not drawn: one of them is among the best with a chance of about 1e-16.
_FLOOR = -40.0
_WAY = np.dtype([("upto", np.float32), ("next", np.int32)])


class Pieces:
    """Vocabulary with log weights.

    A unigram model's scores are log probabilities already. A BPE model has merge
    ranks only; its pieces get a Zipf law of their rank.
    """

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        plain = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        scores = np.array([self.model.get_score(i) for i in range(n)])
        if (scores[plain] < -100).mean() > 0.5:  # ranks
            rank = np.where(scores > -1e8, -scores, n)
            weight = 1.0 / (np.maximum(rank, 0) + 10.0)
            scores = np.log(weight / weight[plain].sum())
        self.byte = np.full(256, -1, np.int64)
        for i in range(n):
            if self.model.is_byte(i):
                self.byte[int(self.model.id_to_piece(i)[1:-1], 16)] = i
        self.byte_weight = float(scores[plain].min()) * sharpness
        self.weight = {self.model.id_to_piece(i): (i, float(scores[i]) * sharpness) for i in plain}
        self.longest = max(map(len, self.weight))
        told = {i: bytes([b]) for b, i in enumerate(self.byte) if i >= 0}
        told |= {i: p.replace(_SPACE, " ").encode() for p, (i, _) in self.weight.items()}
        self.bytes_of = [told.get(i) for i in range(n)]
        self.spelling = pa.array(self.bytes_of, pa.binary())

    def units(self, text: str | None) -> list[str]:
        return _UNIT.findall(_SPACE + text.replace(" ", _SPACE)) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts first goes."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decode_all(self, flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[str]:
        """The texts of ids from ``first`` up to ``last``: all ids are looked up at once."""
        told = self.spelling.take(pa.array(flat))
        if told.null_count:
            raise ValueError("an id without a text")
        _, place, raw = told.buffers()
        place = np.frombuffer(place, np.int32) if place else np.zeros(1, np.int32)
        raw = memoryview(raw) if raw else memoryview(b"")
        return [str(raw[a:b], "utf-8", "replace")[1:] for a, b in zip(place[first].tolist(), place[last].tolist(), strict=True)]


class _Column:
    """A growing array."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        size = len(self.data)
        while self.n + len(values) > size:
            size *= 2
        if size > len(self.data):
            data = np.zeros(size, self.data.dtype)  # what is not written yet takes no memory
            data[: self.n] = self.data[: self.n]
            self.data = data
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


def _hashes(chars: np.ndarray, left: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lengths, places and hashes of the substrings of up to ``n`` characters; ``left`` characters follow a place."""
    mixed = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    at = np.arange(len(chars))
    h = np.full(len(chars), 0x243F6A8885A308D3, np.uint64)
    for length in range(1, n + 1):
        if length > 1:
            fits = left[at] >= length
            at, h = at[fits], h[fits]
        h = (h ^ mixed[at + (length - 1)]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        yield length, at, h


class Lattices(dict):
    """Lattices of distinct units in flat arrays: nodes with edge ranges, edges by falling probability.

    New units of a block are built together: pieces are found by the hashes of all
    substrings, and the masses of the ends of all units run back step by step.
    Units are named by their bytes, with blanks for ``_SPACE``. An edge has a record for
    the walk, ``way``: how far its draw goes and the first edge behind it (-1: the unit ends).
    """

    def __init__(self, pieces: Pieces, most_edges: int = 6_000_000):
        super().__init__()
        self.pieces, self.most = pieces, most_edges
        keys = np.zeros(len(pieces.weight), np.uint64)
        ids = np.zeros(len(keys), np.int32)
        weights = np.zeros(len(keys))
        for i, (piece, (number, weight)) in enumerate(pieces.weight.items()):
            size = len(piece)
            *_, last = _hashes(np.array([ord(c) for c in piece], np.uint32), np.arange(size, 0, -1), size)
            keys[i], ids[i], weights[i] = last[2][0], number, weight
        order = np.argsort(keys)
        self.table, self.piece_id, self.piece_weight = KeyTable(keys[order]), ids[order], weights[order]
        self.reset()

    def reset(self) -> None:
        self.clear()
        if hasattr(self, "way"):
            for column in self.columns:
                column.n = 0
        else:
            self.root, self.again = _Column(np.int64), _Column(bool)
            self.entry, self.first, self.degree = _Column(np.int64), _Column(np.int64), _Column(np.int32)
            self.way, self.logp = _Column(np.uint64), _Column(np.float64)
            self.target, self.source, self.piece = _Column(np.int32), _Column(np.int32), _Column(np.int32)
            self.columns = [self.root, self.again, self.entry, self.first, self.degree, self.way, self.logp, self.target, self.source, self.piece]
        self.spelled: list[list[int]] = []  # byte pieces of characters outside the vocabulary

    def _turn(self) -> None:
        """Forget the units that were not met again, or all where the others fill half of the memory."""
        kept = np.flatnonzero(self.again.data[: len(self)])
        root, entry = self.root.data[kept], self.entry.data[kept]
        nodes = np.append(self.root.data[1 : len(self)], self.first.n)[kept] - root
        wide = np.append(self.entry.data[1 : len(self)], self.logp.n)[kept] - entry
        if 2 * wide.sum() > self.most:
            return self.reset()
        units, spelled = list(compress(self, self.again.data[: len(self)].tolist())), self.spelled
        node, edge = _ranges(root, nodes), _ranges(entry, wide)
        by_edge = np.repeat(np.cumsum(nodes) - nodes - root, wide)
        moved = np.cumsum(wide) - wide - entry
        way = self.way.data[edge].view(_WAY)
        way["next"] = np.where(way["next"] < 0, -1, way["next"] + np.repeat(moved, wide))
        piece = self.piece.data[edge]
        odd = np.flatnonzero(piece < 0)
        held = {
            "root": np.cumsum(nodes) - nodes, "again": np.zeros(len(kept), bool), "entry": np.cumsum(wide) - wide,
            "first": self.first.data[node] + np.repeat(moved, nodes), "degree": self.degree.data[node], "way": way.view(np.uint64),
            "logp": self.logp.data[edge], "target": self.target.data[edge] + by_edge, "source": self.source.data[edge] + by_edge,
        }
        self.reset()
        self.spelled = [spelled[-1 - p] for p in piece[odd].tolist()]
        piece[odd] = -1 - np.arange(len(odd))
        for name, values in (held | {"piece": piece}).items():
            getattr(self, name).add(values)
        self.update(zip(units, range(len(units)), strict=True))

    def _names(self, units: list[bytes]) -> np.ndarray:
        """Codes of different units; new ones are learnt."""
        known = list(map(self.get, units))
        new = [u for u, code in zip(units, known, strict=True) if code is None]
        if not new:
            codes = np.array(known, np.int64)
            self.again.data[codes] = True
            return codes
        codes = np.array([-1 if code is None else code for code in known], np.int64)
        self.again.data[codes[codes >= 0]] = True
        self.again.add(np.zeros(len(new), bool))
        codes[codes < 0] = len(self) + np.arange(len(new))
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        raw = b"".join(new)
        chars = np.frombuffer(raw.decode().replace(" ", _SPACE).encode("utf-32-le"), np.uint32)
        begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80  # bytes that begin a character
        ends = np.cumsum(begins)[np.cumsum([len(u) for u in new]) - 1]
        sizes = np.diff(ends, prepend=0)
        first = done = 0
        while first < len(new):
            last = min(int(np.searchsorted(ends, done + (1 << 17))) + 1, len(new))
            self._learn(chars[done : ends[last - 1]], sizes[first:last])
            first, done = last, int(ends[last - 1])
        return codes

    def codes(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.logp.n > self.most:
            self._turn()
        raw = [b" " + t.replace(_SPACE, " ").encode("utf-8", "replace") if t else b"" for t in texts]
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        # the cuts of Pieces.units: a line break alone, else blanks and what follows them
        space, line = data == 32, data == 10
        begin = line.copy()
        begin[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        begin[starts[starts < ends]] = True
        first = np.flatnonzero(begin)
        place = pa.py_buffer(np.append(first, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(first), [None, place, pa.py_buffer(joined)]).dictionary_encode()
        names = self._names(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = names[coded.indices.to_numpy()]
        cuts = np.searchsorted(first, np.stack([starts, ends]))
        return [codes[a:b] for a, b in cuts.T.tolist()]

    def _learn(self, chars: np.ndarray, sizes: np.ndarray) -> None:
        end = np.repeat(np.cumsum(sizes), sizes)
        left = end - np.arange(len(chars))
        edges = []
        for length, at, h in _hashes(chars, left, min(self.pieces.longest, int(sizes.max()))):
            hit, found = self.table.find_few(h)
            at = at[hit]
            edges.append((at, at + length, self.piece_weight[found], self.piece_id[found]))
            if length == 1:
                bare = np.ones(len(chars), bool)
                bare[at] = False
                odd = np.flatnonzero(bare)
                raw = [chr(c).encode("utf-8", "replace") for c in chars[odd]]
                first = len(self.spelled)
                self.spelled += [[int(self.pieces.byte[b]) for b in r] for r in raw]
                weight = self.pieces.byte_weight * np.array([len(r) for r in raw], float)
                edges.append((odd, odd + 1, weight, (-1 - first - np.arange(len(odd))).astype(np.int32)))
        source, target, gain, piece = (np.concatenate(x) for x in zip(*edges, strict=True))
        # masses of the ends, all units at once by what is left behind a place
        order = np.argsort(source, kind="stable")
        source, target, gain, piece = (x.take(order) for x in (source, target, gain, piece))
        beta = np.zeros(len(chars) + 1)
        behind = np.where(target == end[source], len(chars), target)  # the end of a unit has mass 1
        step = left[source]
        order = np.argsort(step.astype(np.uint16) if sizes.max() < 1 << 16 else step, kind="stable")
        step, place, reached, given = (x.take(order) for x in (step, source, behind, gain))
        cut = np.concatenate(([0], np.flatnonzero(np.diff(step)) + 1, [len(step)]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            value = given[a:b] + beta[reached[a:b]]
            head = np.flatnonzero(np.diff(place[a:b], prepend=-1))
            most = np.maximum.reduceat(value, head)
            wide = np.diff(np.append(head, b - a))
            total = np.add.reduceat(np.exp(value - np.repeat(most, wide)), head)
            beta[place[a:b][head]] = most + np.log(total)
        gain = gain + beta[behind] - beta[source]
        chance = np.exp(gain)
        order = np.argsort(source + (1.0 - chance) * 0.999, kind="stable")  # by place, the likely edges first
        source, target, gain, piece, chance = (x.take(order) for x in (source, target, gain, piece, chance))
        head = np.flatnonzero(np.diff(source, prepend=-1))
        wide = np.diff(np.append(head, len(source)))
        run = np.cumsum(chance)
        upto = run - np.repeat(run[head] - chance[head], wide)
        upto[np.append(head[1:], len(source)) - 1] = 2.0
        # one more node behind every unit
        node, edge = self.first.n, self.logp.n
        unit = np.repeat(np.arange(len(sizes)), sizes)
        number = node + np.arange(len(chars)) + unit
        ends = node + np.cumsum(sizes) + np.arange(len(sizes))
        first = np.full(len(chars) + len(sizes), edge, np.int64)
        degree = np.zeros(len(chars) + len(sizes), np.int32)
        first[number - node] = edge + head
        degree[number - node] = wide
        self.first.add(first)
        self.degree.add(degree)
        behind = target + unit[source]
        way = np.empty(len(source), _WAY)
        way["upto"], way["next"] = upto, np.where(degree[behind] > 0, first[behind], -1)
        self.root.add(ends - sizes)
        self.entry.add(first[ends - sizes - node])
        self.way.add(way.view(np.uint64))
        self.logp.add(gain)
        self.target.add(node + behind)
        self.source.add(number[source])
        self.piece.add(piece)

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of edges one after another, and how many each edge has."""
        piece = self.piece.data[edges]
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return piece, np.ones(len(edges), np.int64)
        count = np.ones(len(edges), np.int64)
        spelled = [self.spelled[-1 - p] for p in piece[odd]]
        count[odd] = [len(x) for x in spelled]
        flat = np.repeat(piece, count)
        at = np.cumsum(count) - count
        flat[_ranges(at[odd], count[odd])] = [i for x in spelled for i in x]
        return flat, count


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)]


@lru_cache(maxsize=1)
def shared_lattices(path: str, sharpness: float) -> Lattices:
    """The lattices of a Python worker, kept from task to task; what they hold changes no result."""
    return Lattices(Pieces(path, sharpness))


@lru_cache(maxsize=1)
def shared_pieces(path: str) -> Pieces:
    """The pieces of a Python worker that decodes, kept from task to task."""
    return Pieces(path)


def _mixed_draws(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64 bits each; ``x`` is used up."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    u = x.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def _counted(seed: np.ndarray, *parts) -> np.ndarray:
    """Bits of a draw: a seed per row and up to three counters."""
    x = seed.astype(np.uint64)
    for p, odd in zip(parts, _ODD, strict=False):
        x = x + (np.atleast_1d(p).astype(np.uint64) + np.uint64(1)) * odd
    return x


def _unit_draws(seed: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) from a seed per row and up to three counters."""
    return _mixed_draws(_counted(seed, *parts))


def _walk(lat: Lattices, here: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample every unit from its first edge (-1: it is at its end) to its end: edges in order, and how many each unit took.

    ``bits`` count the seed, the sample and the place; the steps are counted here.
    """
    ways = lat.way.data
    count = np.zeros(len(here), np.int64)
    active = np.flatnonzero(here >= 0)
    here, bits = here[active], bits[active]
    steps = []
    while len(active):
        u = _mixed_draws(bits + np.uint64((len(steps) + 1) * int(_ODD[2]) % (1 << 64)))
        edge = here
        way = ways.take(edge)
        over = np.flatnonzero(u >= way.view(_WAY)["upto"])
        while len(over):
            edge[over] += 1
            way[over] = ways.take(edge[over])
            over = over[u[over] >= way[over].view(_WAY)["upto"]]
        steps.append((active, edge))
        count[active] += 1
        here = way.view(_WAY)["next"]
        on = np.flatnonzero(here >= 0)
        active, here, bits = active.take(on), here.take(on).astype(np.int64), bits.take(on)
    begin = np.cumsum(count) - count
    edges = np.zeros(int(count.sum()), np.int64)
    for step, (who, edge) in enumerate(steps):
        edges[begin.take(who) + step] = edge
    return edges, count


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] numbers each, one after another."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _best(v: np.ndarray, lead: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest values, and of those equal to one, of every group that begins at ``lead``; all for large ``n``."""
    if n > 8:
        return np.arange(len(v))
    wide = np.diff(np.append(lead, len(v)))
    left, found = v.copy(), np.zeros(len(v), bool)
    for _ in range(n):
        top = np.flatnonzero(left == np.repeat(np.maximum.reduceat(left, lead), wide))
        found[top] = True
        left[top] = -np.inf
    return np.flatnonzero(found)


class Batch:
    """Gumbel top-k over a block of texts."""

    def __init__(self, lat: Lattices, codes: list[np.ndarray], seeds: np.ndarray, k: int):
        self.lat, self.seeds, self.k = lat, seeds, k
        self.units = np.array([len(c) for c in codes], np.int64)
        self.unit_first = np.cumsum(self.units) - self.units
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        self.entry = lat.entry.data[code]
        self.place = _ranges(np.zeros(len(codes), np.int64), self.units)
        self.bits = np.repeat(seeds.astype(np.uint64), self.units) + (self.place.astype(np.uint64) + np.uint64(1)) * _ODD[1]

    def run(self) -> list[tuple[np.ndarray, ...]]:
        """Per sample: texts that have it, values, edges with their starts and counts by text, log masses."""
        lat, n = self.lat, len(self.units)
        docs = np.arange(n)
        value = -np.log(-np.log(_unit_draws(self.seeds, 1 << 40)))
        head = np.zeros(0, np.int64)
        head_count = np.zeros(n, np.int64)
        unit, node, phi = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
        pool = {x: np.zeros(0, kind) for x, kind in (("doc", np.int64), ("v", float), ("phi", float), ("sample", np.int64), ("step", np.int64), ("edge", np.int64))}
        out = []
        for sample in range(self.k + 1):
            if sample == self.k or not len(docs):
                break
            # fresh part: the rest of the unit of the branch, and all units behind it
            left = self.units[docs] - unit
            begins = np.cumsum(left) - left
            part = _ranges(self.unit_first[docs] + unit, left)
            start = self.entry.take(part)
            mid = (node >= 0) & (left > 0)
            start[begins[mid]] = np.where(lat.degree.data[node[mid]] > 0, lat.first.data[node[mid]], -1)
            tail, took = _walk(lat, start, self.bits.take(part) + np.uint64((sample + 1) * int(_ODD[0]) % (1 << 64)))
            ends = np.concatenate(([0], np.cumsum(took)))
            tail_count = ends[begins + left] - ends[begins]
            count = head_count + tail_count
            first = np.cumsum(count) - count
            edges = tail
            if len(head):
                edges = np.empty(len(head) + len(tail), np.int64)
                old = np.repeat(np.tile([True, False], len(docs)), np.stack([head_count, tail_count], 1).ravel())
                edges[old] = head
                edges[~old] = tail
            sums = np.concatenate(([0.0], np.cumsum(lat.logp.data.take(edges))))
            out.append((docs, value, edges, first, count, sums[first + count] - sums[first]))
            # siblings of the fresh steps, as far as their mass counts
            begin = first + head_count
            stop = np.minimum(np.searchsorted(-sums, -sums[first] - _FLOOR) + 1, first + count)  # the sums fall
            most = np.maximum(stop - begin, 0)
            part = _ranges(begin, most)
            owner = np.repeat(np.arange(len(docs)), most)
            step = part - first[owner]
            before = sums[part] - sums[first][owner]
            source = lat.source.data[edges[part]]
            wide = np.flatnonzero((before > _FLOOR) & (lat.degree.data[source] > 1))
            degree = lat.degree.data[source[wide]].astype(np.int64)
            other = _ranges(lat.first.data[source[wide]], degree)
            at = np.repeat(wide, degree)
            nth = _ranges(np.zeros(len(wide), np.int64), degree)
            keep = np.flatnonzero(other != edges[part[at]])
            other, at, nth = other.take(keep), at.take(keep), nth.take(keep)
            mass = before[at] + lat.logp.data[other]
            u = _unit_draws(self.seeds[docs][owner[at]], (1 << 41) + sample, step[at], nth)
            bound = value[owner[at]]
            v = mass - np.log(np.exp(np.minimum(mass - bound, 700.0)) - np.log(u))
            v, who = np.minimum(v, bound), owner[at]
            lead = np.flatnonzero(np.diff(who, prepend=-1))
            if len(lead):  # only the best of each text are sorted
                near = _best(v, lead, self.k - sample)
                v, who, at, nth, other, mass = (x.take(near) for x in (v, who, at, nth, other, mass))
            fresh = {"doc": docs[who], "v": v, "phi": mass, "sample": np.full(len(at), sample), "step": step[at], "edge": other}
            pool = {x: np.concatenate([pool[x], fresh[x]]) for x in pool}
            order = np.lexsort((-pool["v"], pool["doc"]))
            pool = {x: y[order] for x, y in pool.items()}
            lead = np.flatnonzero(np.diff(pool["doc"], prepend=-1))
            rank = np.arange(len(order)) - np.repeat(lead, np.diff(np.append(lead, len(order))))
            pool = {x: y[rank < self.k - sample] for x, y in pool.items()}
            # the best of each pool is the next sample; the pool of the last keeps the threshold
            if sample + 1 == self.k:
                break
            lead = np.flatnonzero(np.diff(pool["doc"], prepend=-1))
            best = {x: y[lead] for x, y in pool.items()}
            stay = np.ones(len(pool["v"]), bool)
            stay[lead] = False
            pool = {x: y[stay] for x, y in pool.items()}
            docs, value, phi = best["doc"], best["v"], best["phi"]
            parts = []
            head_count = best["step"] + 1
            unit = np.zeros(len(docs), np.int64)
            node = lat.target.data[best["edge"]]
            for i, (d, s, t, e) in enumerate(zip(docs, best["sample"], best["step"], best["edge"], strict=True)):
                old_docs, _, old_edges, old_first, _, _ = out[s]
                r = int(np.searchsorted(old_docs, d))
                part = old_edges[old_first[r] : old_first[r] + t + 1].copy()
                part[t] = e
                parts.append(part)
                ends = lat.degree.data[lat.target.data[part[:-1]]] == 0
                unit[i] = int(ends.sum())
            head = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.threshold = np.full(n, -np.inf)
        lead = np.flatnonzero(np.diff(pool["doc"], prepend=-1))
        self.threshold[pool["doc"][lead]] = pool["v"][lead]
        return out


def sample_segmentations(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 3,
    model: str | None = None,
    sharpness: float = 1.0,
    seed: int = 0,
    with_ids: bool = True,
    with_digest: bool = False,
) -> DataFrame:
    """Up to ``k`` rows per input row, distinct segmentations by falling perturbed value.

    Columns: id, sample (from 0), n_pieces, ids_crc32 (of the ids as unsigned 32-bit
    numbers), log_prob (of the segmentation given the text), perturbed (log_prob plus
    its Gumbel), log_inclusion (log of the chance to be among the samples given the
    next largest value) and, with ``with_ids``, ids; with ``with_digest`` also
    decoded_sha256, of the text that :func:`decode_pieces` gives for the ids. A text
    with fewer than ``k`` segmentations gives all of them, with log_inclusion 0.

    A null or empty text has one segmentation, without pieces. A null id is a key of
    its own; rows that share an id and a text give the same samples; an empty table
    gives no rows; other columns are not read.
    """
    path = model or tokenizer_path("piece_bpe_32k.model")

    fields = [("k", pa.string()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [(x, pa.float64()) for x in ("log_prob", "perturbed", "log_inclusion")]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded_sha256", pa.string())] * with_digest
    kind = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = shared_lattices(path, sharpness)
        for batch in batches:
            for keys, texts in slices(batch, 1 << 20):
                seeds = np.array(
                    [int.from_bytes(hashlib.blake2b(f"{seed}:{x}".encode("utf-8", "replace"), digest_size=8).digest(), "little") for x in keys],
                    np.uint64,
                )
                names = pa.array(keys, pa.string())
                made = Batch(lat, lat.codes(texts), seeds, k)
                for sample, (docs, value, edges, first, count, phi) in enumerate(made.run()):
                    flat, lengths = lat.ids(edges)
                    ends = np.concatenate(([0], np.cumsum(lengths)))
                    a, b = ends[first], ends[first + count]
                    kappa = made.threshold[docs]
                    gap = np.minimum(phi - kappa, 700.0)
                    small = np.exp(np.minimum(gap, 0.0)) < 1e-8
                    inclusion = np.where(small, gap, np.log(-np.expm1(-np.exp(np.where(small, 0.0, gap)))))
                    plain = flat.astype("<u4")
                    crc = [zlib.crc32(plain[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    columns = [names.take(pa.array(docs)), np.full(len(docs), sample, np.int32), b - a, np.array(crc, np.int64), phi, value, inclusion]
                    if with_ids:  # the texts' ids stand one after another
                        columns.append(pa.ListArray.from_arrays(np.append(a, len(flat)).astype(np.int32), flat))
                    if with_digest:
                        columns.append([hashlib.sha256(x.encode()).hexdigest() for x in lat.pieces.decode_all(flat, a, b)])
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, kind, strict=True)], schema=kind)

    schema = "k string, sample int, n_pieces bigint, ids_crc32 bigint, log_prob double, perturbed double, log_inclusion double"
    schema += (", ids array<int>" if with_ids else "") + (", decoded_sha256 string" if with_digest else "")
    narrow = df.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"))
    out = narrow.mapInArrow(run, schema)
    return out.withColumn("k", F.col("k").cast(id_type(df, id_col))).withColumnRenamed("k", id_col)


def decode_pieces(df: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """All columns of the input and ``decoded``, the text of the ids; null for null ids."""
    path = model or tokenizer_path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = shared_pieces(path)
        for ids in parts:
            yield ids.map(lambda x: None if x is None else pieces.decode(x.tolist()))

    return df.withColumn("decoded", told(F.col(ids_col)))
