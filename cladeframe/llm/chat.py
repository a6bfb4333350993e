"""Chat formatting as prefix trees.

Conversations that begin with the same turns share the nodes of a tree. Each node is
one formatted turn, named by a digest of its parent's name and of its role and text.
Trees are laid out depth-first, so that a shared turn's tokens occur once. A node
carries its first position id, the part of it that counts for the loss, and the
intervals of its tree's token stream that it may attend to besides itself: those of
its ancestors.

The depth-first order is the order of the paths (the digests from root to leaf, one
after another), so it comes from a range partitioning of the distinct paths. Each
partition is read as a stream that keeps one path; the one row per partition that
the next partition needs is folded in between. No tree is gathered anywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import durable, id_type, tokenizer_path

#: Control strings of the template: user and system turns, other roles, end of a reply (fixed values).
_CONTROL = r"(<)({0})(/?s>)|(\[)({0})(/?(?:INST|SYS|ROLE)\])"
_PLAIN = re.compile(_CONTROL.format(r"\\*"))
_MARKED = re.compile(_CONTROL.format(r"\\+"))
_WIDTH = 16


def escape(text: str) -> str:
    """One more backslash inside everything that is, or looks like, an escaped control string."""
    return _PLAIN.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: f"{m[1] or m[4]}{(m[2] or m[5])[1:]}{m[3] or m[6]}", text)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """Head, escaped text and tail of a turn."""
    body = escape(text)
    if role == "user":
        return "<s>[INST] ", body, " [/INST]"
    if role == "system":
        return "[SYS] ", body, " [/SYS]"
    if role == "assistant":
        return "", body, "</s>"
    return f"[ROLE]{escape(role)}[/ROLE]", body, "</s>"


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0

    def until(mark: str) -> str:
        nonlocal at
        end = text.index(mark, at)
        part = unescape(text[at:end])
        at = end + len(mark)
        return part

    while at < len(text):
        if text.startswith("<s>[INST] ", at):
            at += 10
            turns.append(("user", until(" [/INST]")))
        elif text.startswith("[SYS] ", at):
            at += 6
            turns.append(("system", until(" [/SYS]")))
        elif text.startswith("[ROLE]", at):
            at += 6
            role = until("[/ROLE]")
            turns.append((role, until("</s>")))
        else:
            turns.append(("assistant", until("</s>")))
    return turns


class Coder:
    """Ids of text by a byte-level tokenizer; special strings in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of a turn and the part of them under the loss: the text of an assistant."""
        head, body, tail = (e.ids for e in self.tokenizer.encode_batch(list(formatted(role, text)), add_special_tokens=False))
        ids = head + body + tail
        return (ids, len(head), len(head) + len(body)) if role == "assistant" else (ids, 0, 0)

    def text(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def _digest(parent: bytes, role: str, text: str) -> bytes:
    body = role.encode("utf-8", "replace")
    return hashlib.blake2b(parent + len(body).to_bytes(8, "little") + body + text.encode("utf-8", "replace"), digest_size=_WIDTH).digest()


def _turns(df: DataFrame, path: str, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per conversation (conv, n_turns, path, lens) and per node of a task (node, ids, loss)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(path)
        known: dict[bytes, int] = {}
        names = ["conv", "n_turns", "path", "lens", "node", "parent", "ids", "loss_from", "loss_to"]
        now: object = ()
        nodes: list[bytes] = []
        lens: list[int] = []

        def ended() -> list[tuple]:
            return [(now, len(nodes), b"".join(nodes), lens, None, None, None, 0, 0)] if nodes else []

        for batch in batches:
            rows: list[tuple] = []
            for c, r, t in zip(batch["c"], batch["r"], batch["t"], strict=True):
                c, r, t = (None if c is None or c != c else c), r or "", t or ""
                if c != now:
                    rows += ended()
                    now, nodes, lens = c, [], []
                parent = nodes[-1] if nodes else b""
                node = _digest(parent, r, t)
                if node not in known:
                    ids, a, b = coder.turn(r, t)
                    if len(known) > 200_000:
                        known.clear()
                    known[node] = len(ids)
                    rows.append((None, 0, None, None, node, parent, ids, a, b))
                nodes.append(node)
                lens.append(known[node])
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(ended(), columns=names)

    schema = (
        "conv string, n_turns bigint, path binary, lens array<bigint>, "
        "node binary, parent binary, ids array<int>, loss_from int, loss_to int"
    )
    narrow = df.select(
        F.col(conv).cast("string").alias("c"), F.col(turn).alias("i"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    by = ["c", "i", "r", "t"]
    return narrow.repartition("c").sortWithinPartitions(*by).select("c", "r", "t").mapInPandas(run, schema)


def _shared(a: bytes, b: bytes) -> int:
    """Nodes that two paths share."""
    n = min(len(a), len(b)) // _WIDTH
    if a[: n * _WIDTH] == b[: n * _WIDTH]:
        return n
    low, high = 0, n
    while high - low > 1:  # the first ``low`` nodes agree, the first ``high`` don't
        mid = (low + high) // 2
        if a[low * _WIDTH : mid * _WIDTH] == b[low * _WIDTH : mid * _WIDTH]:
            low = mid
        else:
            high = mid
    return low


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the next partitions need of one: its first and last path and its tokens after the first path."""
    first: bytes | None = None
    first_lens: list[int] = []
    last, starts, total = b"", [], 0
    for batch in batches:
        for path, lens in zip(batch["path"], batch["lens"], strict=True):
            path = bytes(path)
            if first is None:
                first, first_lens, last, starts = path, list(lens), path, [-1] * len(lens)
                continue
            keep = _shared(last, path)
            starts = starts[:keep]
            for n in lens[keep:]:
                starts.append(total)
                total += int(n)
            last = path
    if first is not None:
        row = (TaskContext.get().partitionId(), first, first_lens, last, starts, total)
        yield pd.DataFrame([row], columns=["pid", "first", "first_lens", "last", "starts", "total"])


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where each partition starts, and the path before it with the starts of its nodes."""
    before, starts, base = b"", [], 0
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            rows.append((r.pid, before, list(starts), base))
            keep = _shared(before, bytes(r.first))
            own, at = list(starts[:keep]), base
            for n in r.first_lens[keep:]:
                own.append(at)
                at += int(n)
            starts = [own[d] if s < 0 else at + int(s) for d, s in enumerate(r.starts)]
            before, base = bytes(r.last), at + int(r.total)
        yield pd.DataFrame(rows, columns=["pid", "path", "lens", "base"])


def _laid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes that each path adds, with places relative to their tree."""
    names = ["tree", "node", "parent", "depth", "start", "length", "position", "intervals"]
    before, starts, at = b"", [], 0
    sizes: list[int] | None = None
    spans: list[list[tuple[int, int]]] = []
    for batch in batches:
        rows = []
        for base, path, lens in zip(batch["base"], batch["path"], batch["lens"], strict=True):
            path = bytes(path)
            if base >= 0:  # the row that opens a partition: ``lens`` holds the starts
                before, starts, at, sizes, spans = path, [int(x) for x in lens], int(base), None, []
                continue
            lens = [int(x) for x in lens]
            keep = _shared(before, path)
            if sizes is None or keep < len(spans) or len(spans) < keep:
                kept = [] if sizes is None else spans[:keep]
                for d in range(len(kept), keep):
                    kept.append(_with(kept[d - 1], starts[d - 1], lens[d - 1]) if d else [])
                spans = kept
            starts = starts[:keep]
            position = sum(lens[:keep])
            for d in range(keep, len(lens)):
                spans.append(_with(spans[d - 1], starts[d - 1], lens[d - 1]) if d else [])
                starts.append(at)
                root = starts[0]
                rows.append((
                    path[:_WIDTH], path[d * _WIDTH : (d + 1) * _WIDTH], path[(d - 1) * _WIDTH : d * _WIDTH] if d else b"",
                    d, at - root, lens[d], position, [{"start": a - root, "end": b - root} for a, b in spans[d]],
                ))
                at += lens[d]
                position += lens[d]
            before, sizes = path, lens
        yield pd.DataFrame(rows, columns=names)


def _with(spans: list[tuple[int, int]], start: int, length: int) -> list[tuple[int, int]]:
    """Intervals and one more behind them, joined where they touch."""
    if not length:
        return spans
    if spans and spans[-1][1] == start:
        return [*spans[:-1], (spans[-1][0], start + length)]
    return [*spans, (start, start + length)]


def format_conversations(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokenizer: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The trees and the conversations.

    Nodes: tree, node, parent, depth, start and length in the tree's token stream,
    position (of the first token), intervals (of the ancestors, joined where they
    touch), ids, loss_from and loss_to (in ids). Conversations: id, n_turns, path
    (node names of 16 bytes from the root), node (the last).

    Rows go by turn, ties by role and text; null turns come first. Null texts and
    roles are empty, rows with a null id form one conversation, repeated rows are
    repeated turns. An empty table gives empty results; other columns are not read.
    A conversation's turns pass one task as a stream, its path is a single value.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    made = durable(_turns(df, path, conv_col, turn_col, role_col, text_col))
    convs = made.filter("path IS NOT NULL").select("conv", "n_turns", "path")
    tokens = made.filter("node IS NOT NULL").select("node", "ids", "loss_from", "loss_to").dropDuplicates(["node"])
    paths = made.filter("path IS NOT NULL").select("path", "lens").dropDuplicates(["path"])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = durable(paths.repartitionByRange(n, "path").sortWithinPartitions("path"))
    ends = ordered.mapInPandas(_ends, "pid int, first binary, first_lens array<bigint>, last binary, starts array<bigint>, total bigint")
    folded = ends.repartition(1).sortWithinPartitions("pid").mapInPandas(_folded, "pid int, path binary, lens array<bigint>, base bigint")
    rows = ordered.select(F.spark_partition_id().alias("pid"), "path", "lens", F.lit(-1).cast("bigint").alias("base"))
    opened = rows.unionByName(folded).repartition(n, "pid").sortWithinPartitions("pid", F.desc("base"), "path")
    laid = opened.mapInPandas(
        _laid,
        "tree binary, node binary, parent binary, depth int, start bigint, length bigint, position bigint, "
        "intervals array<struct<start: bigint, end: bigint>>",
    )
    nodes = laid.join(tokens, "node")
    kind = id_type(df, conv_col)
    last = F.substring("path", -_WIDTH, _WIDTH)
    return nodes, convs.select(F.col("conv").cast(kind).alias(conv_col), "n_turns", "path", last.alias("node"))


def read_back(nodes: DataFrame, convs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per distinct last node: turns, digests and lengths, read from the ids of its ancestors and itself."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(path)
        names = ["leaf", "read_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, ids, loss = b"", [], []

        def told() -> list[tuple]:
            if not now:
                return []
            text = coder.text(ids)
            turns = parse(text)
            said = hashlib.sha256()
            for role, body in turns:
                said.update(f"{role}\n{body}\n".encode("utf-8", "replace"))
            under = "".join(unescape(coder.text(x)) for x in loss)
            return [(now, len(turns), said.hexdigest(), len(under), hashlib.sha256(under.encode("utf-8", "replace")).hexdigest(), len(text))]

        for batch in batches:
            rows: list[tuple] = []
            for leaf, part, a, b in zip(batch["leaf"], batch["ids"], batch["loss_from"], batch["loss_to"], strict=True):
                leaf = bytes(leaf)
                if leaf != now:
                    rows += told()
                    now, ids, loss = leaf, [], []
                ids += part.tolist()
                if b > a:
                    loss.append(part[a:b].tolist())
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(told(), columns=names)

    leaves = convs.select("path", F.col("node").alias("leaf")).dropDuplicates(["leaf"])
    steps = F.sequence(F.lit(0), (F.octet_length("path") / _WIDTH).cast("int") - 1)
    walk = leaves.select("leaf", F.posexplode(F.transform(steps, lambda i: F.substring("path", i * _WIDTH + 1, F.lit(_WIDTH)))).alias("d", "node"))
    pieces = walk.join(nodes.select("node", "ids", "loss_from", "loss_to"), "node")
    return (
        pieces.repartition("leaf").sortWithinPartitions("leaf", "d").select("leaf", "ids", "loss_from", "loss_to")
        .mapInPandas(run, "leaf binary, read_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    )
