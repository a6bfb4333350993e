"""Alignment files of any size, read by many tasks.

Spark reads a file as ranges of lines; a line is known by its file, range and place. The lines
that are not blank are packed once, a row for each range, and all later steps deal with ranges. What a
range's first line means depends on everything before it, so every range first tells how
it changes the reader's state, the states at the starts follow from these reports alone,
and then all ranges are read at the same time:

* sequential PHYLIP and own alphabets: the state is how many letters the current row still
  needs. A report lists the states from which the range can be read without a contradiction;
* interleaved PHYLIP: the number of non-blank lines before the range;
* NEXUS: whether a comment is open, which the last bracket tells, and whether the matrix has
  begun or ended. A report tells what happens with a comment open at the start and without.

Nothing holds a file, a row of an alignment or all lines of a file. The result is cells.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.alphabets import CUSTOM_MISSING, alphabet_rows
from cladeframe.sources.alignments import KNOWN, POLYMORPHIC
from cladeframe.session import durable

_AT = ["part", "line"]
#: Lines in a packed row at most; longer ranges are cut.
RANGE_LINES = 4096
#: Reads as missing in every alphabet and is a state in none.
_GAP = "-"
# what Java's \\s has
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_NO_BLANKS = str.maketrans("", "", " \t\n\x0b\f\r")
_COMMENT = re.compile(r"\[[^\]]*(?:\]|\Z)")
_MATRIX = re.compile(r"^[ \t\x0b\f\r]*matrix\b", re.M | re.I | re.A)
_PIECE = "array<struct<taxon:string,start:bigint,text:string>>"


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(aln, part, line, value): lines of text files; ``part`` is the place of the range that Spark read."""
    meta = F.col("_metadata")
    return spark.read.text(path).select(
        meta["file_name"].alias("aln"), meta["file_block_start"].alias("part"), F.monotonically_increasing_id().alias("line"), "value"
    )


def formats(lines: DataFrame) -> DataFrame:
    """(aln, kind, head, head_at): nexus, custom or phylip by the first word of a file."""
    shown = lines.filter(F.trim("value") != "").groupBy("aln").agg(
        F.min(F.struct(*_AT)).alias("head_at"), F.min_by(F.trim("value"), F.struct(*_AT)).alias("head")
    )
    word = F.split("head", r"\s+")[0]
    kind = F.when(F.upper(word) == "#NEXUS", "nexus").when(word == "#SPECIALALPHABET", "custom").otherwise("phylip")
    return shown.select("aln", kind.alias("kind"), "head", "head_at")


def _wrong(condition: Column, text: str, value: Column) -> Column:
    return F.when(condition, F.raise_error(F.concat(F.lit(text), F.col("aln").cast("string"))).cast("string")).otherwise(value)


def packed_ranges(lines: DataFrame) -> DataFrame:
    """(aln, part, lines, ahead): one row per range with its lines that are not blank, in order; ``part`` orders the ranges of a file.

    ``ahead`` counts the lines at the first place: more than one where a place stands twice.
    """
    part = F.struct(F.col("part"), F.floor(F.col("line") / RANGE_LINES).alias("sub"))
    shown = lines.filter(F.col("aln").isNotNull() & (F.trim("value") != ""))
    packed = shown.select("aln", part.alias("part"), F.struct("line", "value").alias("_l")).groupBy("aln", "part").agg(F.sort_array(F.collect_list("_l")).alias("_l"))
    ahead = F.size(F.filter("_l", lambda x: x["line"] == F.get("_l", F.lit(0))["line"]))
    return packed.select("aln", "part", F.col("_l.value").alias("lines"), ahead.alias("ahead"))


def _sizes(ranges: DataFrame, fmt: str) -> DataFrame:
    """(aln, kind, n_taxa, n_sites, letters, head_part, skip): the sizes of a file and where its header ends.

    A header with an own alphabet is its first line or the first two. Sizes of NEXUS files are not in it.
    """
    order = Window.partitionBy("aln").orderBy("part")
    top = ranges.select("aln", "part", F.trim(F.get("lines", F.lit(0))).alias("_a"), F.trim(F.get("lines", F.col("ahead"))).alias("_b"), F.col("ahead").alias("_c"))
    top = top.withColumn("_r", F.row_number().over(order)).filter("_r <= 2").groupBy("aln").agg(
        F.min("part").alias("_p"), F.max("part").alias("_q"),
        *[F.max(F.when(F.col("_r") == r, F.col(c))).alias(f"{c}{r}") for r, c in ((1, "_a"), (1, "_b"), (1, "_c"), (2, "_a"), (2, "_c"))],
    )
    word = F.split("_a1", r"\s+")[0]
    found = F.when(F.upper(word) == "#NEXUS", "nexus").when(word == "#SPECIALALPHABET", "custom").otherwise("phylip")
    kind = found if fmt == "auto" else F.lit(fmt if fmt in ("nexus", "custom") else "phylip")
    kinds = top.withColumn("kind", kind)
    short = (F.col("kind") == "custom") & (F.size(F.split("_a1", r"\s+")) < 4)
    here = F.col("_b1").isNotNull()
    head = F.when(short, F.concat_ws(" ", "_a1", F.coalesce("_b1", "_a2"))).otherwise(F.col("_a1"))
    sizes = kinds.withColumn("_w", F.split(head, r"\s+")).withColumn("_f", F.when(F.col("kind") == "custom", 1).otherwise(0))
    number = lambda i: F.when(F.col("kind") != "nexus", F.get("_w", F.col("_f") + i).cast("bigint"))
    return sizes.select(
        "aln", "kind", number(0).alias("n_taxa"), number(1).alias("n_sites"),
        F.when(F.col("kind") == "custom", F.get("_w", F.lit(3))).alias("letters"),
        F.when(short & ~here, F.col("_q")).otherwise(F.col("_p")).alias("head_part"),
        F.when(short & here, F.col("_c1") + 1).when(short, F.coalesce("_c2", "_c1")).otherwise(F.col("_c1")).alias("skip"),
    )


def _body(ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Ranges without the lines of the header, with the sizes of their file."""
    told = sizes.filter("kind <> 'nexus'").select("aln", "kind", "n_taxa", "n_sites", "head_part", "skip")
    cut = F.when(F.col("part") == F.col("head_part"), F.col("skip")).otherwise(0)
    placed = ranges.select("aln", "part").join(told, "aln").filter("part >= head_part")
    return _started(ranges, placed.select("aln", "part", (F.col("kind") == "custom").alias("own"), "n_taxa", "n_sites", cut.alias("skip")))


def _started(ranges: DataFrame, starts: DataFrame) -> DataFrame:
    """Ranges with what is known of their starts, without lines of the header."""
    rest = F.when(F.col("skip") > 0, F.slice("lines", F.col("skip") + 1, F.size("lines"))).otherwise(F.col("lines"))
    return _with(ranges, starts).withColumn("lines", rest)


def _with(ranges: DataFrame, told: DataFrame) -> DataFrame:
    """Ranges, dealt out once, with a row told of each; the others go."""
    return _dealt(ranges, "aln", "part").join(told, ["aln", "part"])


def _words(lines: list[str], own: bool) -> list[list[str]]:
    """Words of every line that has some; groups of an own alphabet are one missing letter."""
    if own:
        lines = [POLYMORPHIC.sub("?", x) if "(" in x or "{" in x else x for x in lines]
    return [w for w in map(_WORD.findall, lines) if w]


def _lists(rows: Iterable[list], kind: pa.DataType) -> pa.Array:
    """A list column from one Python list a row."""
    rows = list(rows)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), pa.array([x for r in rows for x in r], kind))


def _pieces(rows: list[list[tuple]]) -> pa.Array:
    """A column of pieces (taxon, start, text) from one list a row."""
    flat = [x for r in rows for x in r]
    columns = zip(*flat, strict=True) if flat else ([], [], [])
    arrays = [pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), pa.StructArray.from_arrays(arrays, ["taxon", "start", "text"]))


def _by_file(reports: DataFrame, fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """What ``fold`` makes of the reports of a file in the order of its ranges, file after file of a task."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    columns = {name: kinds[kind] for name, kind in (x.split() for x in schema.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        types: dict[str, pa.DataType] = {}

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))

        for batch in batches:
            types = {c: batch.schema.field(c).type for c in ("aln", "part")} | columns
            done: list[dict] = []
            for r in batch.to_pylist():
                if held and held[0]["aln"] != r["aln"]:
                    done += fold(held)
                    held = []
                held.append(r)
            yield made(done)
        if held:
            yield made(fold(held))

    keys = f"aln {_type(reports)}, part {_type(reports, 'part')}"
    return _dealt(reports, "aln").sortWithinPartitions("aln", "part").mapInArrow(run, f"{keys}, {schema}")


# ---- sequential rows ------------------------------------------------------------------


def range_report(lengths: Iterable[int], n_sites: int) -> list[tuple[int, int, int]]:
    """(letters missing at the start, at the end, names inside) for every start without a contradiction.

    Starts that exceed the whole range are not listed: what is missing then shrinks by it.
    """
    ends = [0, *accumulate(int(x) for x in lengths)]
    last, total = len(ends) - 1, ends[-1]
    at = {e: j for j, e in enumerate(ends)}
    # what is missing at the end and the names met when a row begins with word j
    known: list[tuple[int, int] | None] = [None] * last + [(0, 0)]
    for j in reversed(range(last)):
        goal = ends[j + 1] + n_sites  # word j is a name
        if goal > total:
            known[j] = (goal - total, 1)
        elif (found := known[m] if (m := at.get(goal)) is not None else None) is not None:
            known[j] = (found[0], found[1] + 1)
    out = []
    for end, found in zip(ends, known, strict=True):
        if end > n_sites:
            break
        if found is not None:
            out.append((end, *found))
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every range: its letters, its lines and what it makes of every start."""
    for batch in batches:
        totals, counts, told = [], [], []
        for lines, own, n_sites in zip(*(batch.column(c).to_pylist() for c in ("lines", "own", "n_sites")), strict=True):
            words = _words(lines, own)
            lengths = [len(w) for ws in words for w in ws]
            totals.append(sum(lengths))
            counts.append(len(words))
            told.append(range_report(lengths, n_sites))
        lists = [_lists(([x[i] for x in r] for r in told), pa.int64()) for i in range(3)]
        passed = [batch.column(c) for c in ("aln", "part", "n_taxa", "n_sites", "own", "skip")]
        yield pa.RecordBatch.from_arrays([*passed, pa.array(totals, pa.int64()), pa.array(counts, pa.int64()), *lists], [*_PASSED, "total", "count", "needs", "lefts", "names"])


_PASSED = ["aln", "part", "n_taxa", "n_sites", "own", "skip"]


def _fold(reports: list[dict]) -> list[dict]:
    """The states at the starts of a file's ranges, from their reports, and the lines before them."""
    need, rows, ok, before, out = 0, 0, True, 0, []
    for r in reports:
        out.append({c: r[c] for c in _PASSED} | {"need": need, "rows": rows, "before": before})
        before += r["count"]
        if not ok:
            continue
        if need in r["needs"]:
            hit = r["needs"].index(need)
            need, rows = r["lefts"][hit], rows + r["names"][hit]
        elif need > r["total"]:
            need -= r["total"]
        else:
            ok = False
    fits = ok and need == 0 and rows == reports[0]["n_taxa"]
    return [x | {"fits": fits} for x in out]


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a range, one for each row of the alignment in it.

    ``first`` is the number of the row that began before the range, ``begun`` its piece; ``open`` is the
    number of the row that goes on behind the range and ``name`` its taxon, if that stands in the range.
    """
    for batch in batches:
        pieces, first, begun, going, name = [], [], [], [], []
        for lines, own, n_sites, need, rows in zip(*(batch.column(c).to_pylist() for c in ("lines", "own", "n_sites", "need", "rows")), strict=True):
            found: list[tuple] = []
            taxon, start, text, row = None, n_sites - need, [], rows - 1
            old = None
            for words in _words(lines, own):
                for w in words:
                    if need:
                        text.append(w)
                        need -= len(w)
                    else:
                        if text and taxon is None:
                            old = (None, start, "".join(text))
                        elif text:
                            found.append((taxon, start, "".join(text)))
                        taxon, start, text, row, need = w, 0, [], row + 1, n_sites
            if text and taxon is None:
                old = (None, start, "".join(text))
            elif text:
                found.append((taxon, start, "".join(text)))
            pieces.append(found)
            first.append(rows - 1 if old else None)
            begun.append([old] if old else [])
            going.append(row if need and taxon is not None else None)
            name.append(taxon)
        arrays = [batch.column("aln"), batch.column("part"), _pieces(pieces), pa.array(first, pa.int64()), _pieces(begun), pa.array(going, pa.int64()), pa.array(name, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["aln", "part", "pieces", "first", "begun", "open", "name"])


def _type(lines: DataFrame, column: str = "aln") -> str:
    return lines.schema[column].dataType.simpleString()


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Small bytes, much work per byte: keep the partition number instead of merging by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sequential_starts(body: DataFrame) -> DataFrame:
    """(aln, part, ..., need, rows, before, fits): the reader's state where a range starts, and whether its file can be read so."""
    keys = f"aln {_type(body)}, part {_type(body, 'part')}"
    told = body.mapInArrow(
        _report, f"{keys}, n_taxa bigint, n_sites bigint, own boolean, skip int, total bigint, count bigint, needs array<bigint>, lefts array<bigint>, names array<bigint>"
    )
    return _by_file(told, _fold, "n_taxa bigint, n_sites bigint, own boolean, skip int, need bigint, rows bigint, before bigint, fits boolean")


def sequential_pieces(ranges: DataFrame, starts: DataFrame) -> DataFrame:
    """(aln, part, pieces) of the files that fit."""
    keys = f"aln {_type(ranges)}, part {_type(ranges, 'part')}"
    placed = durable(_started(ranges, starts.filter("fits")).mapInArrow(_place, f"{keys}, pieces {_PIECE}, first bigint, begun {_PIECE}, open bigint, name string"))
    names = placed.filter("open IS NOT NULL").select("aln", F.col("open").alias("first"), F.col("name").alias("_taxon"))
    named = F.transform("begun", lambda x: F.struct(F.col("_taxon").alias("taxon"), x["start"].alias("start"), x["text"].alias("text")))
    cut = placed.filter("first IS NOT NULL").join(names, ["aln", "first"]).select("aln", "part", named.alias("pieces"))
    return placed.filter(F.size("pieces") > 0).select("aln", "part", "pieces").unionByName(cut)


# ---- interleaved rows and NEXUS -----------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every line of an interleaved file: first word and letters."""
    for batch in batches:
        at, rows, blocks, firsts, texts = [], [], [], [], []
        for k, (lines, own, n_taxa, before) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lines", "own", "n_taxa", "before")), strict=True)):
            for i, words in enumerate(_words(lines, own), before):
                at.append(k)
                rows.append(i % n_taxa)
                blocks.append(i // n_taxa)
                firsts.append(words[0])
                texts.append("".join(words))
        taken = pa.array(at, pa.int64())
        arrays = [batch.column("aln").take(taken), batch.column("part").take(taken), batch.column("n_sites").take(taken)]
        arrays += [pa.array(x, k) for x, k in ((rows, pa.int64()), (blocks, pa.int64()), (firsts, pa.string()), (texts, pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, ["aln", "part", "n_sites", "row", "block", "first", "text"])


def interleaved_pieces(ranges: DataFrame, starts: DataFrame) -> DataFrame:
    """Blocks of one line per taxon; later blocks may repeat the names. (aln, part, pieces)."""
    keys = f"aln {_type(ranges)}, part {_type(ranges, 'part')}"
    lines = _started(ranges, starts).mapInArrow(_blocks, f"{keys}, n_sites bigint, row bigint, block bigint, first string, text string")
    order = Window.partitionBy("aln", "row").orderBy("block")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = _dealt(lines, "aln", "row").withColumn("taxon", F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    letters = F.when(F.col("first") == F.col("taxon"), F.expr("substring(text, length(first) + 1)")).otherwise(F.col("text"))
    texts = named.withColumn("text", letters).withColumn("_n", F.length("text"))
    started = texts.withColumn("start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(every))
    taxon = _wrong(F.col("_all") != F.col("n_sites"), "sizes do not match the header of ", F.col("taxon"))
    return durable(started.select("aln", "part", F.array(F.struct(taxon.alias("taxon"), "start", "text")).alias("pieces")))


def _plain(lines: list[str], inside: bool) -> str:
    """The lines without what stands in square brackets, also over several lines; ``inside``: a comment is open before them."""
    text = "\n".join(lines)
    if text.count("\n") >= len(lines):  # a line break inside a line
        text = "\n".join(x.replace("\n", " ") for x in lines)
    if inside:
        text = "[" + text
    return _COMMENT.sub(lambda m: "\n" * m.group().count("\n"), text) if "[" in text else text


def _matrix_at(text: str) -> tuple[int | None, int | None, int | None]:
    """Lines of the matrix keyword, of the first semicolon on a line behind it and of the first semicolon."""
    def line(i: int) -> int | None:
        return None if i < 0 else text.count("\n", 0, i)

    semicolon = text.find(";")
    found = _MATRIX.search(text)
    if not found:
        return None, None, line(semicolon)
    after = text.find("\n", found.end())
    return line(found.end()), line(text.find(";", after)) if after >= 0 else None, line(semicolon)


def _nexus_report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every range: its last bracket and where the matrix begins and ends, with no comment open at the start and with one."""
    for batch in batches:
        ends, counts, found = [], [], []
        for lines in batch.column("lines").to_pylist():
            text = _plain(lines, False)
            raw = "\n".join(lines)
            ends.append(None if "[" not in raw and "]" not in raw else raw.rfind("[") > raw.rfind("]"))
            counts.append(len(lines))
            found.append((*_matrix_at(text), *(_matrix_at(_plain(lines, True)) if "]" in raw else (None, None, None))))
        columns = zip(*found, strict=True) if found else [[]] * 6
        arrays = [batch.column("aln"), batch.column("part"), pa.array(ends, pa.bool_()), pa.array(counts, pa.int64()), *(pa.array(list(c), pa.int64()) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, ["aln", "part", "opens", "count", "m0", "s0", "f0", "m1", "s1", "f1"])


def _nexus_fold(reports: list[dict]) -> list[dict]:
    """Of every range that has lines of the head or rows of the matrix: whether a comment is open, and which lines they are."""
    inside, begun, out = False, False, []
    for r in reports:
        matrix, stop, first = (r[f"{c}{int(inside)}"] for c in "msf")
        head, low, high = None, None, None
        if begun:
            low, high = 0, first
        elif matrix is None:
            head = r["count"]
        else:
            begun, head, low, high = True, matrix, matrix + 1, stop
        ended = low is not None and high is not None
        if low is not None and high is None:
            high = r["count"]
        out.append({"aln": r["aln"], "part": r["part"], "inside": inside, "head": head, "low": low, "high": high})
        if ended:
            break
        inside = inside if r["opens"] is None else r["opens"]
    return out if begun else []


def _nexus_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a range, one for each taxon in it, and the lines before the matrix."""
    for batch in batches:
        pieces, heads = [], []
        for lines, inside, head, low, high in zip(*(batch.column(c).to_pylist() for c in ("lines", "inside", "head", "low", "high")), strict=True):
            clean = _plain(lines, inside).split("\n")
            heads.append(None if not head else "\n".join(clean[:head]))
            found: dict[str, list[str]] = {}
            for row in clean[low:high] if low is not None else []:
                row = row.replace("\t", " ").replace("\r", " ").strip(" ")
                if row:
                    taxon, _, text = row.partition(" ")
                    text = text.translate(_NO_BLANKS)
                    found.setdefault(taxon, []).append(POLYMORPHIC.sub("?", text) if "(" in text or "{" in text else text)
            pieces.append([(t, 0, "".join(x)) for t, x in found.items()])
        yield pa.RecordBatch.from_arrays([batch.column("aln"), batch.column("part"), pa.array(heads, pa.string()), _pieces(pieces)], ["aln", "part", "head", "pieces"])


def nexus_pieces(ranges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((aln, part, pieces), (aln, n_taxa, n_sites, datatype), (aln, _n)): the matrix between its keyword and the next semicolon, the sizes told and the taxa found."""
    keys = f"aln {_type(ranges)}, part {_type(ranges, 'part')}"
    told = ranges.mapInArrow(
        _nexus_report, f"{keys}, opens boolean, count bigint, m0 bigint, s0 bigint, f0 bigint, m1 bigint, s1 bigint, f1 bigint"
    )
    starts = _by_file(told, _nexus_fold, "inside boolean, head bigint, low bigint, high bigint")
    read = durable(_with(ranges, starts).mapInArrow(_nexus_rows, f"{keys}, head string, pieces {_PIECE}"))
    head = read.filter("head IS NOT NULL").groupBy("aln").agg(F.array_sort(F.collect_list(F.struct("part", "head"))).alias("_h"))
    text = F.array_join(F.transform("_h", lambda h: h["head"]), "\n")
    size = r"(?i)dimensions[^;]*?=\s*(\d+)[^;]*?=\s*(\d+)"
    heads = head.select(
        "aln", F.regexp_extract(text, size, 1).cast("bigint").alias("n_taxa"), F.regexp_extract(text, size, 2).cast("bigint").alias("n_sites"),
        F.lower(F.regexp_extract(text, r"(?i)datatype\s*=\s*(\w+)", 1)).alias("datatype"),
    )
    found = read.filter(F.size("pieces") > 0).select("aln", "part", "pieces")
    sizes = found.select("aln", "part", F.inline("pieces")).select("aln", "part", "taxon", F.length("text").alias("_v"))
    taxa = durable(sizes.groupBy("aln", "taxon").agg(F.count(F.lit(1)).alias("_c")))
    # a taxon of several ranges goes on where the one before ends
    several = taxa.filter("_c > 1").select("aln", "taxon")
    pieces = found
    if not several.isEmpty():
        before = Window.partitionBy("aln", "taxon").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        later = sizes.join(several, ["aln", "taxon"], "left_semi").withColumn("_s", F.coalesce(F.sum("_v").over(before), F.lit(0)))
        shifts = later.groupBy("aln", "part").agg(F.map_from_entries(F.collect_list(F.struct("taxon", "_s"))).alias("_m"))
        moved = F.transform("pieces", lambda x: F.struct(x["taxon"].alias("taxon"), F.coalesce(F.col("_m")[x["taxon"]], F.lit(0)).alias("start"), x["text"].alias("text")))
        pieces = found.join(shifts, ["aln", "part"], "left").select("aln", "part", F.when(F.col("_m").isNull(), F.col("pieces")).otherwise(moved).alias("pieces"))
    return pieces, heads, taxa.groupBy("aln").agg(F.count(F.lit(1)).alias("_n"))


# ---- letters to states --------------------------------------------------------------------


def _symbols(name: str) -> dict[str, str]:
    return {r[1]: r[2] or _GAP for r in alphabet_rows(name, *KNOWN[name])}


def _others(letters: Iterable[str]) -> str:
    """A pattern for one character that is none of the letters."""
    return "[^" + "".join(c if c.isalnum() else f"\\{c}" for c in letters) + "]"


def _alphabets(text: Column) -> dict[str, Column]:
    """Whether DNA, RNA and protein have all letters of a text that is not empty."""
    return {name: ~text.rlike(_others(_symbols(name))) & (text != "") for name in KNOWN}


def _states(files: DataFrame) -> DataFrame:
    """Cells of pieces with (alphabet, letters); a letter that the alphabet lacks raises.

    The letters of a piece become states as one text, where every missing cell is a gap.
    """
    pieces = files.select("aln", "alphabet", "letters", "wrong", F.inline("pieces"))
    text = F.col("text")
    told = F.when(F.col("wrong").isNotNull(), F.raise_error(F.col("wrong")).cast("string"))
    for name in KNOWN:
        table = _symbols(name)
        moved = "".join(c for c, x in table.items() if c != x)
        unknown = F.raise_error(F.concat(F.lit("unknown letter "), F.regexp_extract(text, _others(table), 0))).cast("string")
        known = F.when(text.rlike(_others(set("".join(table.values())))), F.translate(text, moved, "".join(table[c] for c in moved))).otherwise(text)
        told = told.when(F.col("alphabet") == name, F.when(_alphabets(text)[name], known).otherwise(unknown))
    missing = "".join(CUSTOM_MISSING)
    left = F.call_function("translate", text, F.concat(F.coalesce("letters", F.lit("")), F.lit(missing)), F.lit(""))
    unknown = F.raise_error(F.concat(F.lit("unknown letter "), F.substring(left, 1, 1))).cast("string")
    gaps = F.when(text.rlike(_others(missing).replace("^", "", 1)), F.translate(text, missing, _GAP * len(missing))).otherwise(text)
    own = F.when((left != "") | (text == ""), unknown).otherwise(gaps)
    split = F.split(told.otherwise(own), "")
    cells = pieces.select("aln", "taxon", "start", F.posexplode(split).alias("_at", "_ch"))
    return cells.select("aln", "taxon", (F.col("start") + F.col("_at")).cast("int").alias("site"), F.when(F.col("_ch") != _GAP, F.col("_ch")).alias("state"))


def _told(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """Pieces with what is known of their file: files meet the names of the ranges first, so that a large one stays in many tasks."""
    return _with(pieces, pieces.select("aln", "part").distinct().join(files, "aln"))


def _said(text: str) -> Column:
    return F.concat(F.lit(text), F.col("aln").cast("string"))


def scan_cells(lines: DataFrame, fmt: str = "auto") -> DataFrame:
    """Cells (aln, taxon, site, state) of the alignments whose lines are (aln, part, line, value).

    ``part`` numbers ranges of lines in the order of the file and ``line`` the lines inside a
    range. ``fmt``: auto, nexus, custom, phylip, sequential or interleaved. Cells that a short
    NEXUS row lacks are missing. Sizes that contradict the header, unknown letters and a taxon
    that stands twice raise.
    """
    ranges = durable(packed_ranges(lines))
    sizes = durable(_sizes(ranges, fmt))
    present = {r["kind"] for r in sizes.select("kind").distinct().collect()}  # at most three
    none = F.lit(None).cast("string")
    found: list[DataFrame] = []
    if "nexus" in present:
        pieces, heads, count = nexus_pieces(ranges.join(sizes.filter("kind = 'nexus'").select("aln"), "aln", "left_semi") if len(present) > 1 else ranges)
        files = heads.join(count, "aln").select(
            "aln", F.col("datatype").alias("alphabet"), none.alias("letters"),
            F.when(~F.coalesce(F.col("datatype").isin(list(KNOWN)), F.lit(False)), _said("not a NEXUS alignment: "))
            .when(F.col("_n") != F.col("n_taxa"), _said("wrong number of taxa in ")).alias("wrong"),
        )
        found.append(_told(pieces, files))
    if present - {"nexus"}:
        body = _body(ranges, sizes)
        starts = durable(sequential_starts(body))
        # at most two; a way that no file takes reads no range
        fitting = [r["fits"] for r in starts.select("fits").distinct().collect()] if fmt != "interleaved" else [False]
        ways = [sequential_pieces(ranges, starts)] if True in fitting else []
        if False in fitting:
            rest = starts if fmt == "interleaved" else starts.filter("NOT fits")
            if fmt in ("sequential", "custom"):
                rest = rest.withColumn("aln", _wrong(F.lit(True), "sizes do not match the header of ", F.col("aln").cast("string")).cast(_type(lines)))
            ways.append(interleaved_pieces(ranges, rest))
        pieces = reduce(DataFrame.unionByName, ways)
        flat = pieces.select("aln", F.inline("pieces"))
        told = flat.groupBy("aln", "taxon").agg(F.sum(F.length("text")).alias("_all"), *[F.bool_and(fits).alias(n) for n, fits in _alphabets(F.col("text")).items()])
        wrong = F.bool_or(F.col("_all") != F.col("n_sites"))
        files = told.join(sizes.select("aln", "kind", "n_sites", "letters"), "aln").groupBy("aln", "kind", "letters").agg(wrong.alias("_twice"), *[F.bool_and(n).alias(n) for n in KNOWN])
        guessed = F.coalesce(F.when(F.col("kind") == "custom", "custom"), *[F.when(F.col(n), n) for n in KNOWN])
        files = files.select(
            "aln", guessed.alias("alphabet"), "letters",
            F.when(F.col("_twice"), _said("a taxon stands twice in ")).when(guessed.isNull(), _said("no alphabet has all letters of ")).alias("wrong"),
        )
        found.append(_told(pieces, files))
    if not found:
        return lines.sparkSession.createDataFrame([], f"aln {_type(lines)}, taxon string, site int, state string")
    return _states(reduce(DataFrame.unionByName, found))


def scan_alignments(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """Cells of all files under ``path``; large files are read by many tasks."""
    return scan_cells(file_lines(spark, path), fmt)
