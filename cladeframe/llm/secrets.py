"""Secret scans through nested encodings.

Each text is the first item of a worklist. A scanned layer yields further layers:
percent escapes, backslash escapes, base64 runs, compressed payloads and UTF-16
runs are decoded, mapped back to the original code points and scanned in turn until
no new layer appears. A layer whose text and place were seen before is not followed.

A decoded layer is read byte by byte, one character per byte: what the rules and the
encodings look for is ASCII, so neither control nor other bytes hide it. A base64 run
is read from each of its first four characters, which covers every payload that
begins inside it; compressed payloads may begin anywhere in a decoded layer.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the output; decoded kinds follow the plain ones.
KINDS = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*KINDS, *(f"decoded_{k}" for k in KINDS), "oversize"))}
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}")
#: Escapes of string literals as well: quotes, line breaks, octal digits.
_LITERAL = re.compile(_ESCAPE.pattern + r"""|\\[0-7]{1,3}|\\[abfnrtv"'\\/]""")
_NAMED = dict(zip("abfnrtv", "\a\b\f\n\r\t\v", strict=True))
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_STANDARD = str.maketrans("-_", "+/")
_WIDE = re.compile(r"\x00?(?:[\x01-\x7f]\x00){8,}[\x01-\x7f]?")
_ZLIB = [bytes((c, f)) for c in range(0x08, 0x80, 0x10) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 0x20]
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|" + b"|".join(map(re.escape, _ZLIB)), re.DOTALL)
#: Bytes one compressed payload may unfold to; a larger one is reported as a span of its own.
MAX_UNFOLDED = 64 << 20


@dataclass(frozen=True)
class Place:
    """Where the characters of a layer lie in the layer above."""

    above: Place | None
    up: Callable[[int, int], tuple[int, int]]


@dataclass(frozen=True)
class Layer:
    """A text and its place; no place: the original text. No text: too large to unfold."""

    text: str | None
    place: Place | None = None

    def original(self, a: int, b: int) -> tuple[int, int]:
        """Original code points under the characters a to b."""
        place = self.place
        while place is not None:
            a, b = place.up(a, b)
            place = place.above
        return a, b


def scan(text: str) -> list[tuple[str, int, int]]:
    """The plain spans of one layer (code points, end exclusive)."""
    found = []
    raw = text.encode("utf-8", "replace").lower()
    if any(w in raw for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"akia" in raw:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _member(data: memoryview, room: int, step: int) -> tuple[bytes, int, bool, bool]:
    """Content of the compressed member at the start of ``data``, bytes read, whether it ended, and whether it broke.

    ``room`` bounds the content. The input goes in by ``step`` bytes, then ever more; what a broken step held is lost.
    """
    bz = data[:3] == b"BZh"
    z = bz2.BZ2Decompressor() if bz else zlib.decompressobj(47)
    parts, at, grown = [], 0, step > 1
    try:
        while at < len(data) and not z.eof and room > 0:
            parts.append(z.decompress(data[at : at + step], room))
            room -= len(parts[-1])
            at = min(at + step, len(data))
            while bz and not z.eof and not z.needs_input and room > 0:
                parts.append(z.decompress(b"", room))
                room -= len(parts[-1])
            step = step * 2 if grown else step
        return b"".join(parts), at - len(z.unused_data), z.eof, False
    except (zlib.error, OSError, EOFError, ValueError):
        return b"".join(parts), at, False, True


def _unfold(data: memoryview, start: int) -> tuple[bytes, int, bool, bool]:
    """Content of the compressed payload at ``start`` with all members behind it, its end, and whether it ended and is whole."""
    parts, at, room = [], start, MAX_UNFOLDED + 1
    while True:
        content, used, ended, broken = _member(data[at:], room, 256)
        if broken:  # once more byte by byte, to keep all that comes before the break
            content, used, ended, _ = _member(data[at:], room, 1)
        parts.append(content)
        room -= len(content)
        at += used
        if room <= 0 or not ended:
            break
        follows = at
        while follows < len(data) and data[follows] == 0:
            follows += 1
        if not _MAGIC.match(data, follows):
            break
        at = follows
    return b"".join(parts), at, ended, room > 0


def _within(layer: Layer, a: int, b: int) -> Place:
    """The place of a text that as a whole lies under the characters a to b."""
    return Place(layer.place, lambda x, y: (a, b))


def _from_escapes(layer: Layer, spans: list[tuple[int, int, str]]) -> Iterator[Layer]:
    """One layer per line that holds escapes (no rule crosses a line break); ``spans`` are (start, end, decoded)."""
    text = layer.text
    at = 0
    while at < len(spans):
        here = text.rfind("\n", 0, spans[at][0]) + 1
        stop = -1
        parts: list[str] = []
        # pieces of the line: where they begin in the decoded text and in this one; escapes have an end
        begin, left, right = [], [], []
        n = 0
        while at < len(spans) and (stop < 0 or spans[at][0] < stop):
            a, b, plain = spans[at]
            for x, y, piece in ((here, None, text[here:a]), (a, b, plain)):
                if piece:
                    parts.append(piece)
                    begin.append(n)
                    left.append(x)
                    right.append(y)
                    n += len(piece)
            here = b
            at += 1
            if stop < here:  # once a line
                stop = text.find("\n", here)
                stop = len(text) if stop < 0 else stop
        if here < stop:
            parts.append(text[here:stop])
            begin.append(n)
            left.append(here)
            right.append(None)

        def up(a: int, b: int, begin: list[int] = begin, left: list[int] = left, right: list[int | None] = right) -> tuple[int, int]:
            i, j = bisect_right(begin, a) - 1, bisect_right(begin, b - 1) - 1
            return (
                left[i] + a - begin[i] if right[i] is None else left[i],
                left[j] + b - begin[j] if right[j] is None else right[j],
            )

        yield Layer("".join(parts), Place(layer.place, up))


def _escaped(m: re.Match) -> str:
    if m[0][1] not in "uUx":
        return chr(int(m[0][1:], 8) & 0xFF) if m[0][1].isdigit() else _NAMED.get(m[0][1], m[0][1])
    value = int(m[0][2:].strip("{}"), 16)
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else m[0]


def layers(layer: Layer) -> Iterator[Layer]:
    """The layers one step below."""
    text = layer.text
    if "%" in text:
        spans = []
        for m in _PERCENT.finditer(text):
            plain = bytes.fromhex(m[0].replace("%", "")).decode("latin-1")
            spans += [(m.start() + 3 * i, m.start() + 3 * i + 3, c) for i, c in enumerate(plain)]
        yield from _from_escapes(layer, spans)
    if "\\" in text:
        strict = []
        for escape in (_ESCAPE, _LITERAL):
            spans = [(m.start(), m.end(), c) for m in escape.finditer(text) if (c := _escaped(m)) != m[0]]
            if spans != strict:
                yield from _from_escapes(layer, spans)
            strict = spans
    for m in _BASE64.finditer(text):
        run = m[0].rstrip("=").translate(_STANDARD)
        for phase in range(4):
            body = run[phase:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            data = base64.b64decode(body + "=" * (-len(body) % 4))

            def up(a: int, b: int, first: int = m.start() + phase, last: int = m.end(), n: int = len(data)) -> tuple[int, int]:
                # a secret that fills the run takes the padding along
                return first + a * 8 // 6, last if (a, b) == (0, n) else min(first - (-b * 8 // 6), last)

            yield Layer(data.decode("latin-1"), Place(layer.place, up))
    if layer.place is None:
        return
    if "\0" in text:
        for m in _WIDE.finditer(text):
            # either byte order: the character and its zero byte are a pair
            def pair(a: int, b: int, first: int = m.start(), last: int = m.end()) -> tuple[int, int]:
                return first + 2 * a, min(first + 2 * b, last)

            yield Layer(m[0].replace("\0", ""), Place(layer.place, pair))
    data = memoryview(text.encode("latin-1", "replace"))
    at = 0
    while m := _MAGIC.search(data, at):
        content, end, ended, whole = _unfold(data, m.start())
        place = _within(layer, m.start(), end)
        if not whole:
            yield Layer(None, place)
        elif content:
            yield Layer(content.decode("latin-1"), place)
        at = end if ended or not whole else m.start() + 1


def _digest(text: str | None) -> str | bytes | None:
    if text is None or len(text) < 64:
        return text
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def find_secrets(text: str | None) -> list[tuple[str, int, int, int]]:
    """Spans (kind, start, end, depth) of a text and of all layers inside it."""
    first = Layer(text or "")
    found = [(k, a, b, 0) for k, a, b in scan(first.text)]
    work, seen, known = [(first, 0)], set(), set()
    # a layer of escapes holds the plain characters around them too: what was found there is not found again
    same = {(k, a, b, first.text[a:b]) for k, a, b, _ in found}
    while work:
        layer, depth = work.pop()
        for below in layers(layer):
            if below.text == "":
                continue
            ends = below.original(0, len(below.text or "x"))
            key = (_digest(below.text), *ends)
            if key in seen:
                continue
            seen.add(key)
            if below.text is None:
                found.append(("oversize", *ends, depth + 1))
                continue
            for kind, x, y in scan(below.text):
                a, b = below.original(x, y)
                if (kind, a, b, below.text[x:y]) in same:
                    continue
                same.add((kind, a, b, below.text[x:y]))
                span = (f"decoded_{kind}", a, b)
                if span not in known:
                    known.add(span)
                    found.append((*span, depth + 1))
            work.append((below, depth + 1))
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]], x[2], x[3]))


SPAN = "array<struct<kind: string, start: bigint, end: bigint, depth: int>>"


def secret_spans(df: DataFrame, text_col: str = "text", redact: str | None = None) -> DataFrame:
    """All columns of the input and ``spans``, sorted by start and kind.

    Plain spans have depth 0; ``decoded_*`` kinds lie inside ``depth`` encodings and
    give the original characters that carry them; ``oversize`` marks a compressed
    payload beyond ``MAX_UNFOLDED`` bytes, to be looked at by other means. With
    ``redact`` a column ``clean_text`` has that string in place of every span,
    overlaps merged.

    A null or empty text has no spans; a null text stays null in ``clean_text``.
    Null ids and repeated rows are rows like any other, an empty table gives no
    rows. Input columns with the names of the added ones are replaced.
    """

    @F.pandas_udf(f"spans {SPAN}, clean_text string")
    def found(texts: pd.Series) -> pd.DataFrame:
        spans = [find_secrets(t) for t in texts]
        rows = [[{"kind": k, "start": a, "end": b, "depth": d} for k, a, b, d in s] for s in spans]
        clean = [None if redact is None else _replaced(t, s, redact) for t, s in zip(texts, spans, strict=True)]
        return pd.DataFrame({"spans": rows, "clean_text": clean})

    added = ["spans"] if redact is None else ["spans", "clean_text"]
    own = [c for c in df.columns if c not in added]
    made = df.withColumn("_found", found(F.col(text_col)))
    return made.select(*own, *(F.col("_found")[c].alias(c) for c in added))


def _replaced(text: str | None, spans: list[tuple[str, int, int, int]], mark: str) -> str | None:
    if text is None or not spans:
        return text
    parts, here, end = [], 0, -1
    for _, a, b, _ in spans:
        if a >= end:
            if end >= 0:
                parts.append(mark)
                here = end
            parts.append(text[here:a])
        end = max(end, b)
    return "".join([*parts, mark, text[end:]])


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the plain spans and the text of all spans."""
    base = F.filter("spans", lambda s: s["depth"] == 0)

    def n(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        id_col, *(n(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
