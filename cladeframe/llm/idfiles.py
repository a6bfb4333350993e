"""Token-id files: adaptive context mixing drives a range coder over independent blocks.

A file is a run of segments, one row each of a Parquet folder: the documents of the
segment (keys and numbers of ids) and one binary value that holds its ids. A segment
numbers its ids by use and cuts them into blocks. Every block has a coder and a model
of its own that start from nothing, and a checksum of its ids. An id is coded in steps:

* is it the predicted id? The last id behind the same two ids (order 2) or else the
  same id (order 1) is the prediction, the most used id (order 0) where neither is known.
  How often each order was right with such support before is stretched, weighted and
  added up; the weights learn from every outcome;
* if not, its order-0 frequency class (a power of two of its number) and its sixteenth of
  the class, as one symbol by counts that adapt, and the rest of the number flat.

All arithmetic is on integers, so that every machine decodes what another one coded.
The blocks of a segment step together: one step of the coder is one numpy call over
all of them.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import id_type, release, shared_folder, tokenizer_path
from cladeframe.llm.words import blocks, memory

MAGIC = b"CXB2"
_HEAD = struct.Struct("<4sQIII")  # magic, ids, ids a block, distinct ids, blocks
_U64 = np.uint64
#: A coder puts out words of 20 bits; its range lies between 2^40 and 2^60 after every step.
_WORD = _U64(20)
_TWO = _U64(40)
_SMALL = _U64(1 << 40)
_CARRY = np.uint32(1 << 20)

#: A probability of 12 bits on the logistic scale (256 = 1), and back to 16 bits.
_STRETCH = np.array([round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)], np.int16)
_SQUASH = np.array([min(65_000, max(32, round(65536 / (1 + math.exp(-d / 256))))) for d in range(-2047, 2048)], np.int32)

#: By support + 16 where the id was as seen: what is added to an entry, and all bits where the id takes its place.
_TURN = np.array([-(s - (s >> 1)) for s in range(16)] + [s < 15 for s in range(16)], np.int64).astype(np.uint32)
_SHAKEN = np.where(np.arange(32) < 2, 0xFFFFFFFF, 0).astype(np.uint32)

#: Four running sums of 16 bits in one value: what an occurrence adds to the sums (shifted by its
#: field, to those from its own on), sums of equal counts, and the highest bits.
_STEP = 24  # what one occurrence adds to a count
_FIELD = _U64(16)
_MASK = _U64(0xFFFF)
_LAST = _U64(48)
_BITS = _U64(4)
_THREE = _U64(3)
_GAIN = _U64(sum(_STEP << 16 * i for i in range(4)))
_EQUAL = sum((i + 1) << 16 * i for i in range(4))
_ONES = _U64(0x0001_0001_0001_0001)
_HIGH = _U64(0x8000_8000_8000_8000)


def _spare(distinct: int) -> int:
    """Lowest bits of a number that are coded flat, as a number has 16 other bits at most."""
    return max(0, (max(distinct, 1) - 1).bit_length() - 16)


def _classes(distinct: int) -> np.ndarray:
    """Class (high four bits) and sixteenth of the class (low four) by number."""
    high = np.arange(max(distinct, 1)) >> _spare(distinct)
    kind = np.maximum(np.frexp(np.maximum(high, 1).astype(np.float64))[1] - 1, 0)
    offset = np.where(kind > 0, high - (1 << kind), high)
    return (kind << 4 | offset >> np.maximum(kind - 4, 0)).astype(np.uint8)


class _Counts:
    """Counts of 256 symbols a lane, class and sixteenth in one: a tree of four levels, every node
    the running sums of its four branches in one value. A sum stays below 2^15."""

    def __init__(self, lanes: int, start: int = 4):
        self.levels = [np.full(lanes * many, _EQUAL * (start * 64 // many), _U64) for many in (1, 4, 16, 64)]

    def encode(self, at: np.ndarray, symbol: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the symbols of the lanes add to the lower ends of the ranges, and the new ranges."""
        symbol = symbol.astype(_U64)
        below = unit = share = None
        for down, sums in zip((6, 4, 2, 0), self.levels, strict=True):
            which = symbol >> _U64(down)
            which &= _THREE
            own = sums.take(at)
            field = which << _BITS
            before = own << _FIELD
            before >>= field
            before &= _MASK
            if below is None:
                unit, below = width // (own >> _LAST), before
            else:
                below += before
            if not down:
                share = own >> field
                share &= _MASK
                share -= before
            own += _GAIN << field
            sums[at] = own
            at = at << 2
            at += which.view(np.int64)
        below *= unit
        share *= unit
        return below, share

    def decode(self, at: np.ndarray, code: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols, and the codes and ranges behind them."""
        first = at
        below = unit = share = wanted = None
        for down, sums in zip((6, 4, 2, 0), self.levels, strict=True):
            own = sums.take(at)
            if below is None:
                total = own >> _LAST
                unit = width // total
                total -= _U64(1)
                wanted = np.minimum(code // unit, total)
            more = wanted * _ONES
            more |= _HIGH
            more -= own
            more &= _HIGH
            which = np.bitwise_count(more).astype(_U64)  # how many of the sums are at most the wanted one
            field = which << _BITS
            before = own << _FIELD
            before >>= field
            before &= _MASK
            if below is None:
                below = before.copy()
            else:
                below += before
            if down:
                wanted -= before
            else:
                share = own >> field
                share &= _MASK
                share -= before
            own += _GAIN << field
            sums[at] = own
            at = at << 2
            at += which.view(np.int64)
        below *= unit
        share *= unit
        return (at - (first << 8)).astype(np.uint8), code - below, share


class _Lanes:
    """Models and coders of the blocks of a segment; lane = block."""

    def __init__(self, lanes: int, slots: int, distinct: int):
        self.shift = np.uint32(32 - (slots.bit_length() - 1))
        self.slot0 = np.arange(2 * lanes) * slots
        self.hashes = np.zeros(2 * lanes, np.uint32)
        self.seen = np.zeros(2 * lanes * slots, np.uint32)  # id << 4 | support, by context of order 1 and 2
        self.first = np.zeros(lanes, np.uint32)  # share of the last id in the hash of order 2
        self.right0 = np.arange(3 * lanes) * 16
        self.states = np.zeros(3 * lanes, np.uint8)  # class of the guess, support of order 1 and of order 2
        self.right = np.full(3 * lanes * 16, 1 << 12, np.uint16)  # share of right predictions, by state
        self.weight = np.full((3, lanes), 22_000, np.int32)
        self.both = np.zeros(2 * lanes, np.uint32)  # the ids, for both orders
        self.age = 0
        self.counts = _Counts(lanes)
        self.range = np.full(lanes, (1 << 60) - 1, _U64)
        self.classes = _classes(distinct)
        self.spare = _spare(distinct)
        self.bits = np.array([max((s >> 4) - 4, 0) + self.spare for s in range(256)], _U64)  # the flat rest of a number, by symbol

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The predicted id and the chance (16 bits) that it is right."""
        lanes = len(self.first)
        one = self.both[:lanes]
        np.multiply(one, np.uint32(2654435761), out=self.hashes[:lanes])
        np.add(one * np.uint32(2246822519), self.first, out=self.hashes[lanes:])
        np.multiply(one, np.uint32(3266489917), out=self.first)
        np.right_shift(self.hashes, self.shift, out=self.hashes)
        self.slots = self.hashes.astype(np.int64)
        self.slots += self.slot0
        self.entries = entries = self.seen.take(self.slots)
        self.ids = ids = entries >> np.uint32(4)
        self.support = support = entries.astype(np.uint8) & np.uint8(15)
        one, two = ids[:lanes], ids[lanes:]
        guess = two - one
        guess *= support[lanes:] > 0
        guess += one
        states = self.states
        np.right_shift(self.classes.take(guess), np.uint8(4), out=states[:lanes])
        np.multiply(support[:lanes], one == guess, out=states[lanes : 2 * lanes])
        states[2 * lanes :] = support[lanes:]
        self.at = states.astype(np.int64)
        self.at += self.right0
        share = self.right.take(self.at)
        self.share = share.astype(np.int32)
        self.stretched = _STRETCH.take(share >> np.uint16(4)).reshape(3, lanes)
        x = self.weight * self.stretched
        total = x[0] + x[1]
        total += x[2]
        total >>= 16
        total += 2047
        self.chance = _SQUASH.take(total, mode="clip")
        return guess, self.chance

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        lanes = len(ids)
        truth = hit.astype(np.int32) << 16
        gap = truth - self.share.reshape(3, lanes)
        gap >>= 4
        self.right[self.at] = (self.share + gap.ravel()).astype(np.uint16)
        truth -= self.chance
        truth >>= 2
        step = self.stretched * truth
        step >>= 15
        self.weight += step
        self.age += 1
        if not self.age % 32:  # a step moves a weight by less than 1 200
            np.minimum(self.weight, 1 << 18, out=self.weight)
            np.maximum(self.weight, -(1 << 18), out=self.weight)
        both = self.both
        both[:lanes] = both[lanes:] = ids
        entries = self.entries
        state = (self.ids == both).view(np.uint8) * np.uint8(16)
        state |= self.support
        state = state.astype(np.int64)
        fresh = both << np.uint32(4)
        fresh |= np.uint32(1)
        entries += _TURN.take(state)  # one more support where the id is the same, else half of it
        fresh ^= entries
        fresh &= _SHAKEN.take(state)
        entries ^= fresh
        self.seen[self.slots] = entries


def _steps(numbered: np.ndarray, lanes: int, size: int) -> np.ndarray:
    """The numbers of all lanes by step; the last lane is filled up with zeros."""
    padded = np.zeros(lanes * size, np.uint32)
    padded[: len(numbered)] = numbered
    return np.ascontiguousarray(padded.reshape(lanes, size).T)


def _joined(words: list[np.ndarray], owner: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Words a lane, and the words by lane; the highest bit of a word is added to the word before it."""
    lane = np.concatenate(owner)
    out = np.concatenate(words)[np.argsort(lane, kind="stable")]
    over = np.flatnonzero(out >= _CARRY)
    while len(over):
        out[over] ^= _CARRY
        over -= 1
        out[over] += np.uint32(1)
        over = over[out[over] >= _CARRY]
    return np.bincount(lane, minlength=lanes), out


def _bytes(words: np.ndarray) -> bytes:
    """Words of 20 bits, five bytes a pair."""
    even = np.append(words, np.zeros(len(words) % 2, np.uint32)).astype("<u8").reshape(-1, 2)
    pairs = even[:, 0] << _WORD | even[:, 1]
    return pairs.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _words(payload: bytes, at: int) -> np.ndarray:
    """The words of ``_bytes``, and some zeros behind them."""
    raw = np.frombuffer(payload, np.uint8, (len(payload) - at) // 5 * 5, at).reshape(-1, 5)
    wide = np.zeros((len(raw) + 2, 8), np.uint8)
    wide[:-2, :5] = raw
    pairs = wide.view("<u8")
    return np.concatenate([pairs >> _WORD, pairs & _U64((1 << 20) - 1)], 1).astype(np.uint32).ravel()


def encode_block_ids(ids: np.ndarray) -> bytes:
    """One segment: head, distinct ids by use, table of the blocks, words of the coders."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    most = int(ids.max(initial=0))
    if most < 1 << 22:
        uses = np.bincount(ids)
        alphabet = np.flatnonzero(uses)
        alphabet = alphabet[np.argsort(-uses[alphabet], kind="stable")].astype(np.uint32)
        place = np.zeros(most + 1, np.uint32)
        place[alphabet] = np.arange(len(alphabet))
        numbered = place.take(ids)
    else:  # sparse ids
        alphabet, number, uses = np.unique(ids, return_inverse=True, return_counts=True)
        by_use = np.argsort(-uses, kind="stable")
        place = np.empty(len(by_use), np.uint32)
        place[by_use] = np.arange(len(by_use))
        alphabet, numbered = alphabet[by_use], place.take(number)
    size = 1 << min(10, max(6, (max(n, 1) // 1024).bit_length()))
    lanes = -(-n // size)
    head = _HEAD.pack(MAGIC, n, size, len(alphabet), lanes) + alphabet.astype("<u4").tobytes()
    if not n:
        return head
    steps = _steps(numbered, lanes, size)
    del numbered
    model = _Lanes(lanes, size, len(alphabet))
    lane = np.arange(lanes, dtype=np.uint16 if lanes < 1 << 16 else np.uint32)
    words: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    low, width = np.zeros(lanes, _U64), model.range

    def settle(lane: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        """Put out the highest word, with a carry above it, until the range is large."""
        small = np.flatnonzero(width < _SMALL)
        while len(small):
            lows = low.take(small)
            high = lows >> _TWO
            words.append(high.astype(np.uint32))
            owner.append(lane.take(small))
            high <<= _TWO
            lows ^= high
            lows <<= _WORD
            low[small] = lows
            widths = width.take(small)
            widths <<= _WORD
            width[small] = widths
            small = small[widths < _SMALL]

    for now in steps:
        guess, chance = model.predict()
        hit = now == guess
        bound = (width >> _FIELD) * chance.astype(_U64)
        missed = hit.astype(_U64) - _U64(1)  # all bits where the prediction is wrong
        low += bound & missed
        width -= bound
        width ^= (width ^ bound) & ~missed
        miss = np.flatnonzero(~hit)
        if len(miss):
            number = now.take(miss)
            lows, widths = low.take(miss), width.take(miss)
            symbol = model.classes.take(number)
            step, widths = model.counts.encode(miss, symbol, widths)
            lows += step
            if model.spare > 3:  # a long rest needs a large range
                settle(lane.take(miss), lows, widths)
            bits = model.bits.take(symbol)
            widths >>= bits
            lows += widths * (number & ((_U64(1) << bits) - _U64(1)))
            low[miss], width[miss] = lows, widths
        settle(lane, low, width)
        model.learn(now, hit)
    for _ in (1, 2, 3):
        high = low >> _TWO
        words.append(high.astype(np.uint32))
        owner.append(lane)
        low = (low ^ (high << _TWO)) << _WORD
    filled, out = _joined(words, owner, lanes)
    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
    sums = [zlib.crc32(raw[a : a + 4 * size]) for a in range(0, 4 * n, 4 * size)]
    table = np.stack([filled.astype("<u4"), np.array(sums, "<u4")], 1)
    return b"".join([head, table.tobytes(), _bytes(out)])


def decode_block_ids(payload: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError where a block's checksum differs."""
    magic, n, size, distinct, lanes = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    alphabet = np.frombuffer(payload, "<u4", distinct, at)
    at += 4 * distinct
    if not n:
        return alphabet[:0]
    table = np.frombuffer(payload, "<u4", 2 * lanes, at).reshape(lanes, 2)
    at += 8 * lanes
    filled = table[:, 0].astype(np.int64)
    words = _words(payload, at)
    place = np.cumsum(filled) - filled
    code = words[place].astype(_U64) << _TWO | words[place + 1].astype(_U64) << _WORD | words[place + 2]
    place += 3
    model = _Lanes(lanes, size, distinct)
    width = model.range
    first = np.array([(s & 15) << max((s >> 4) - 4, 0) | (1 << (s >> 4) if s >> 4 else 0) for s in range(256)], _U64)
    first <<= _U64(model.spare)  # the lowest number of a symbol

    def settle(place: np.ndarray, code: np.ndarray, width: np.ndarray) -> None:
        small = np.flatnonzero(width < _SMALL)
        while len(small):
            at = place.take(small)
            codes = code.take(small)
            codes <<= _WORD
            codes |= words.take(at, mode="clip")
            code[small] = codes
            at += 1
            place[small] = at
            widths = width.take(small)
            widths <<= _WORD
            width[small] = widths
            small = small[widths < _SMALL]

    steps = np.empty((size, lanes), np.uint32)
    for t in range(size):
        guess, chance = model.predict()
        bound = (width >> _FIELD) * chance.astype(_U64)
        hit = code < bound
        missed = hit.astype(_U64) - _U64(1)
        code -= bound & missed
        width -= bound
        width ^= (width ^ bound) & ~missed
        now = guess.copy()
        miss = np.flatnonzero(~hit)
        if len(miss):
            symbol, codes, widths = model.counts.decode(miss, code.take(miss), width.take(miss))
            if model.spare > 3:
                places = place.take(miss)
                settle(places, codes, widths)
                place[miss] = places
            bits = model.bits.take(symbol)
            widths >>= bits
            rest = np.minimum(codes // widths, (_U64(1) << bits) - _U64(1))
            codes -= widths * rest
            code[miss], width[miss] = codes, widths
            rest += first.take(symbol)
            now[miss] = np.minimum(rest, _U64(distinct - 1)).astype(np.uint32)  # beyond it only in damaged words
        settle(place, code, width)
        model.learn(now, hit)
        steps[t] = now
    del model
    ids = np.ascontiguousarray(steps.T).reshape(-1)[:n]
    ids = alphabet.take(ids)
    raw = memoryview(ids).cast("B")
    for lane, a in enumerate(range(0, 4 * n, 4 * size)):
        if zlib.crc32(raw[a : a + 4 * size]) != table[lane, 1]:
            raise ValueError(f"block {lane} is damaged")
    return ids


_SEGMENT = "file int, at bigint, n_ids bigint, keys array<string>, sizes array<bigint>, payload binary"


def write_ids(
    df: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    segment_ids: int = 1 << 22,
) -> None:
    """Write the ids of all texts, ``end_id`` behind each, in ascending order of the id column.

    Rows are dealt to files by ranges of the id, so file numbers ascend with it; equal ids
    are spread by a digest of their texts. A null id comes first, a null text is an empty
    one, repeated rows are written as often as they occur, an empty table gives a folder
    without segments; other columns are not read. A segment holds whole documents: about
    ``segment_ids`` ids, or one longer document.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    tie = F.xxhash64("t")
    dealt = rows.repartitionByRange(F.col("k").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("k").asc_nulls_first(), tie, "t"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        file = context.partitionId() if context else 0
        coder = memory(path, byte_level=True)
        keys: list[str | None] = []
        held: list[np.ndarray] = []
        at = waiting = 0

        def segment() -> pd.DataFrame:
            ids = np.concatenate(held)
            sizes = [len(x) for x in held]
            return pd.DataFrame({
                "file": [file], "at": [at], "n_ids": [len(ids)], "keys": [keys], "sizes": [sizes], "payload": [encode_block_ids(ids)]
            })

        for batch in batches:
            names, texts = batch["k"].tolist(), batch["t"].tolist()
            for lo, hi in blocks(texts):
                for name, ids in zip(names[lo:hi], coder.encode(texts[lo:hi]), strict=True):
                    keys.append(name)
                    held.append(np.append(ids, np.uint32(end_id)))
                    waiting += len(held[-1])
                    if waiting >= segment_ids:
                        yield segment()
                        at, waiting, keys, held = at + waiting, 0, [], []
        if held:
            yield segment()
        keys, held = [], []
        release()

    made = dealt.select(F.col("k").cast("string").alias("k"), "t").mapInPandas(run, _SEGMENT)
    made.write.option("compression", "uncompressed").parquet(folder)


def read_ids(spark, folder: str, key_type: str = "bigint", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32[, ids]) of the documents of a folder of ``write_ids``.

    ``start`` counts the ids of all documents before it. Every block is checked.
    """
    table = spark.read.schema(_SEGMENT).parquet(folder)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = (  # one row a file, at most one file a shuffle partition of the writer
        table.groupBy("file").agg(F.sum("n_ids").alias("n"))
        .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, at, keys, sizes, payload in zip(
                batch["file"], batch["at"], batch["keys"], batch["sizes"], batch["payload"], strict=True
            ):
                ids = decode_block_ids(payload)
                ends = np.cumsum(sizes)
                docs = [ids[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                out = pd.DataFrame({
                    "k": list(keys), "file": file, "at": at + ends - sizes, "n_tokens": sizes,
                    "ids_crc32": [zlib.crc32(d.tobytes()) for d in docs],
                })
                yield out.assign(ids=[d.astype(np.int32) for d in docs]) if with_ids else out
        release()

    schema = "k string, file int, at bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    told = table.select("file", "at", "keys", "sizes", "payload").mapInPandas(run, schema)
    out = told.join(F.broadcast(files), "file")
    columns = ["n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return out.select(F.col("k").cast(key_type).alias(id_col), (F.col("offset") + F.col("at")).alias("start"), *columns)


def encode_table(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, folder: str | None = None
) -> DataFrame:
    """Write the ids of a table to ``folder`` (else a new one in the shared folder) and read them back."""
    place = folder or f"{shared_folder(df.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_ids(df, place, id_col, text_col, tokenizer, end_id)
    return read_ids(df.sparkSession, place, id_type(df, id_col), id_col)
