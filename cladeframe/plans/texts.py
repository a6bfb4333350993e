"""Parsers and line builders on text made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe import tables as t
from cladeframe.plans.views_sql import cte, rnd, tidy
from cladeframe.sources import chains as sc
from cladeframe.sources import scan
from cladeframe.sources import writers as sw

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def _order_lines(spark, d, sep, *columns):
    """One line per order: run = status, iter = order key, the columns as text."""
    texts = [c if isinstance(c, str) else c.cast("string") for c in columns]
    return t.load(spark, d, "orders").select(
        F.col("o_orderstatus").alias("run"), F.col("o_orderkey").alias("iter"), F.concat_ws(sep, *texts).alias("value")
    )


def _days():
    return F.datediff("o_orderdate", F.lit("1992-01-01"))


_DAYS = "date_diff('day', DATE '1992-01-01', o_orderdate::DATE)"


@register("parse_trees", (
    "SELECT o_orderstatus AS run, o_orderkey AS iter, '(a:' || o_orderkey || ',(b:' || o_custkey || ',c:1):2);' AS newick FROM orders WHERE o_custkey % 3 > 0"
))
def _(spark, d):
    """Tree records broken over lines; records that hold no tree are left out."""
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    tree = F.concat(F.lit("\n (a:"), key, F.lit(",\n\t(b:"), customer, F.lit(", c:1):2)"))
    orders = t.load(spark, d, "orders")
    records = orders.select(F.col("o_orderstatus").alias("run"), F.col("o_orderkey").alias("iter"), F.when(F.col("o_custkey") % 3 > 0, tree).otherwise(" no tree ").alias("value"))
    return sc.parse_trees(records)


@register("parse_traces", cte("trace_ev", f"SELECT run, iter, param, {rnd('value', 'value')} FROM trace_ev"))
def _(spark, d):
    """Trace texts: a header per run, then tab-separated lines whose first three columns are dropped."""
    long = t.event_trace(spark, d)
    own = lambda p: F.max(F.when(F.col("param") == p, F.col("value"))).cast("string")
    body = long.groupBy("run", "iter").agg(own("value").alias("a"), own("k").alias("b")).select(
        "run", (F.col("iter") + 1).alias("iter"), F.concat_ws("\t", F.col("iter").cast("string"), F.lit("0.1"), F.lit("1"), "a", "b").alias("value")
    )
    heads = long.select("run").distinct().select("run", F.lit(0).cast("bigint").alias("iter"), F.lit("#iter\ttime\ttopo\tvalue\tk").alias("value"))
    return tidy(sc.parse_traces(heads.unionByName(body)))


@register("parse_site_scores", (
    f"SELECT o_orderstatus AS run, o_orderkey AS site, {rnd('o_totalprice', 'logl', 3)}, {rnd('o_custkey', 'var', 3)}, {rnd('-o_totalprice', 'logcpo', 3)}, "
    f"{rnd('o_custkey / 8.0', 'ess_cpo', 3)}, {rnd('1.5', 'logpostmeanl', 3)}, {rnd(_DAYS, 'ess_l', 3)} FROM orders"
))
def _(spark, d):
    lines = _order_lines(
        spark, d, "\t", F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_custkey"), -F.col("o_totalprice"), F.col("o_custkey") / 8, F.lit("1.5"), _days()
    )
    head = lines.select("run").distinct().select("run", F.lit("site\tlogl\tvar\tlogcpo\tess\tlogpostmeanl\tess").alias("value"))
    return tidy(sc.parse_site_scores(lines.select("run", "value").unionByName(head)), 3)


_STEP = ["o_custkey / 4.0", "o_custkey", "-o_totalprice", "2.5", "0.0", _DAYS, "o_custkey", "o_totalprice"]


@register("parse_stepping", (
    "SELECT o_orderstatus AS run, o_orderkey AS cycle, "
    + ", ".join(rnd(x, n, 3) if n != "npoint" else f"{x} AS npoint" for x, n in zip(_STEP, sc.STEPPING, strict=True))
    + ", " + ", ".join(f"CASE WHEN o_custkey % 2 = 0 THEN {rnd('o_custkey', 'x', 3).removesuffix(' AS x')} END AS {n}" for n in sc.PILOT) + " FROM orders"
))
def _(spark, d):
    """Lines of eight columns, or fourteen with a pilot pass for even customers."""
    eight = [F.col("o_custkey") / 4, F.col("o_custkey"), -F.col("o_totalprice"), F.lit("2.5"), F.lit("0"), _days(), F.col("o_custkey"), F.col("o_totalprice")]
    pilot = F.when(F.col("o_custkey") % 2 == 0, F.concat_ws("  ", *[F.col("o_custkey").cast("string")] * 6))
    lines = _order_lines(spark, d, " ", *eight, pilot).withColumnRenamed("iter", "cycle")
    return tidy(sc.parse_stepping(lines), 3)


@register("parse_site_logl", (
    "SELECT run, iter, site, " + rnd("logl", "logl", 3) + " FROM (SELECT o_orderstatus AS run, o_orderkey AS iter, "
    f"unnest([0::BIGINT, 1, 2]) AS site, unnest([-o_totalprice, o_custkey::DOUBLE, {_DAYS}::DOUBLE]) AS logl FROM orders)"
))
def _(spark, d):
    return tidy(sc.parse_site_logl(_order_lines(spark, d, "\t ", -F.col("o_totalprice"), F.col("o_custkey"), _days())), 3)


@register("parse_genes", "SELECT s_suppkey AS gene, s_suppkey * 10 + 1 AS site_begin, s_suppkey * 10 + 10 AS site_end FROM supplier")
def _(spark, d):
    """Gene lines of the suppliers; the counts between them are skipped."""
    key = F.col("s_suppkey")
    lines = F.array(F.concat_ws(" ", key, key * 10 + 1, key * 10 + 10), key.cast("string"))
    return tidy(sc.parse_genes(t.load(spark, d, "supplier").select(F.explode(lines).alias("value"))))


@register("parse_exclusions", "SELECT o_orderkey AS aln, unnest([o_custkey, o_custkey + 1]) AS gene FROM orders")
def _(spark, d):
    """Lists of two genes; what follows the counted ones is not read."""
    text = F.concat_ws("\n", F.lit("2"), F.col("o_custkey"), F.col("o_custkey") + 1, F.lit("99"))
    lists = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("aln"), text.alias("value"))
    return tidy(sc.parse_exclusions(lists, "aln"))


@register("parse_mixture", (
    "WITH m AS (SELECT o_orderkey AS name, o_custkey % 7 + 1.0 AS a, o_custkey % 5 + 0.0 AS b FROM orders), "
    "r AS (SELECT name, 0::BIGINT AS comp, a / (a + 1) AS weight, 'A' AS state, a / (a + greatest(b, 0.5)) AS freq FROM m UNION ALL "
    "SELECT name, 0, a / (a + 1), 'C', greatest(b, 0.5) / (a + greatest(b, 0.5)) FROM m UNION ALL "
    "SELECT name, 1, 1 / (a + 1), 'A', 0.25 / (0.5 + 0.5) * 2 FROM m UNION ALL SELECT name, 1, 1 / (a + 1), 'C', 0.5 FROM m) "
    f"SELECT name, comp, {rnd('weight', 'weight')}, state, {rnd('freq', 'freq')} FROM r"
))
def _(spark, d):
    """Mixtures of two components over two letters; frequencies below one half are raised to it."""
    a, b = (F.col("o_custkey") % 7 + 1).cast("string"), (F.col("o_custkey") % 5).cast("string")
    text = F.concat_ws(" ", F.lit("2 A C\n2\n"), a, a, b, F.lit("\n1 0.5 0.5"))
    return tidy(sc.parse_mixture(t.load(spark, d, "orders").select(F.col("o_orderkey").alias("name"), text.alias("value")), 0.5))


@register("parse_posthyper", f"SELECT o_orderstatus AS run, o_orderkey AS line, {rnd('o_totalprice', 'shape', 3)}, {rnd('o_custkey', 'rate', 3)} FROM orders WHERE o_custkey % 4 > 0")
def _(spark, d):
    """Lines of two numbers; others are skipped."""
    third = F.when(F.col("o_custkey") % 4 == 0, F.lit("x"))
    return tidy(sc.parse_posthyper(_order_lines(spark, d, " ", F.col("o_totalprice"), F.col("o_custkey"), third).withColumnRenamed("iter", "line")), 3)


_SEQ = (
    ", u AS (SELECT DISTINCT taxon FROM cells_ev), g AS (SELECT taxon, range AS site FROM u CROSS JOIN ev_sites), "
    "s AS (SELECT g.taxon::VARCHAR AS taxon, string_agg(coalesce(substr(c.state, 1, 1), '-'), '' ORDER BY g.site) AS seq "
    "FROM g LEFT JOIN cells_ev c ON c.taxon = g.taxon AND c.site = g.site GROUP BY 1) "
)


def _letters(spark, d):
    return t.cells_ev(spark, d).withColumn("state", F.substring("state", 1, 1))


@register("phylip_lines", cte(
    "cells_ev ev_sites",
    _SEQ + "SELECT 1::BIGINT AS part, rpad(taxon, (SELECT max(length(taxon)) + 2 FROM s)::INT, ' ') || seq AS value FROM s UNION ALL SELECT 0, count(*) || ' ' || (SELECT count(*) FROM ev_sites) FROM s",
))
def _(spark, d):
    return tidy(sw.phylip_lines(_letters(spark, d), t.n_sites(spark, d, t.SIX_HOURS)).select(F.col("_part").alias("part"), "value"))


@register("fasta_lines", cte("cells_ev ev_sites", _SEQ + "SELECT '>' || taxon || chr(10) || seq AS value FROM s"))
def _(spark, d):
    return sw.fasta_lines(_letters(spark, d), t.n_sites(spark, d, t.SIX_HOURS))


# ---- documents as alignment files ----------------------------------------------------

_WIDTH = 60
_NUC = "".join("ACGT"[i % 4] for i in range(26))
_DOC_ROWS = (
    "WITH s AS (SELECT doc_id::VARCHAR AS aln, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', "
    f"'{_NUC}') AS s FROM documents WHERE text IS NOT NULL), "
    f"c AS (SELECT aln, unnest(range(length(s))) AS i, unnest(string_split(s, '')) AS ch FROM s WHERE s <> '') "
)
_DOC_CELLS = _DOC_ROWS + (
    f"SELECT aln, ch AS state, count(*) AS n, sum(i % {_WIDTH})::BIGINT AS site_sum, sum(i // {_WIDTH})::BIGINT AS row_sum FROM c GROUP BY 1, 2"
)


def _doc_rows(spark, d):
    """(aln, n, row, seq): the ASCII letters of every document as nucleotides, cut in rows of 60 and filled up with '-'."""
    letters = F.translate(F.regexp_replace("text", "[^A-Za-z]+", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", _NUC * 2)
    docs = t.load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("aln"), letters.alias("s")).filter("s <> ''")
    n = F.ceil(F.length("s") / _WIDTH)
    # one pass over a text, not one up to every row
    pieces = F.regexp_extract_all("s", F.lit(f".{{1,{_WIDTH}}}"), F.lit(0))
    rows = docs.select("aln", n.alias("n"), F.posexplode(pieces).alias("row", "part"))
    return rows.select("aln", "n", F.col("row").cast("bigint").alias("row"), F.rpad("part", _WIDTH, "-").alias("seq"))


def _lines(rows, head, body):
    """Lines (aln, part, line, value) in short ranges: ``head`` and ``body`` are arrays of (place, value) of a file and of a row."""
    every = F.when(F.col("row") == 0, F.concat(head, body)).otherwise(body)
    both = rows.select("aln", F.explode(every).alias("x")).select("aln", F.col("x.at").alias("line"), F.col("x.value").alias("value"))
    return both.select("aln", F.floor(F.col("line") / 50).alias("part"), "line", "value")


def _at(place, value):
    return F.struct(place.cast("bigint").alias("at"), value.alias("value"))


def _taxon():
    return F.concat(F.lit("r"), F.col("row"))


def _counted(cells):
    """States of every file with sums over their places."""
    row = F.substring("taxon", 2, 20).cast("bigint")
    return tidy(cells.filter(F.col("state").isNotNull()).groupBy("aln", "state").agg(
        F.count(F.lit(1)).alias("n"), F.sum("site").alias("site_sum"), F.sum(row).alias("row_sum")
    ))


def _sequential_lines(rows, head):
    """A row on one line, or on two with a blank inside the second."""
    one = F.concat_ws(" ", _taxon(), "seq")
    two = [F.concat_ws("  ", _taxon(), F.substring("seq", 1, 25)), F.concat_ws(" ", F.substring("seq", 26, 20), F.substring("seq", 46, 15))]
    at = F.col("row") * 3
    body = F.when(F.col("row") % 3 == 0, F.array(_at(at + 2, one))).otherwise(F.array(_at(at + 2, two[0]), _at(at + 3, two[1])))
    return _lines(rows, head, body)


@register("scan_sequential", _DOC_CELLS)
def _(spark, d):
    """Documents written as sequential PHYLIP and read in ranges."""
    rows = _doc_rows(spark, d)
    return _counted(scan.scan_cells(_sequential_lines(rows, F.array(_at(F.lit(0), F.concat_ws(" ", "n", F.lit(_WIDTH)))))))


@register("scan_custom", _DOC_CELLS)
def _(spark, d):
    """The same behind a header with an alphabet of its own."""
    rows = _doc_rows(spark, d)
    head = F.array(_at(F.lit(0), F.lit("#SPECIALALPHABET")), _at(F.lit(1), F.concat_ws(" ", "n", F.lit(_WIDTH), F.lit("ACGT"))))
    return _counted(scan.scan_cells(_sequential_lines(rows, head)))


@register("scan_interleaved", _DOC_CELLS)
def _(spark, d):
    """Two blocks of all rows with a blank line between them, names repeated for even documents."""
    rows = _doc_rows(spark, d)
    even = F.col("aln").cast("bigint") % 2 == 0
    second = F.when(even, F.concat_ws(" ", _taxon(), F.substring("seq", 31, 30))).otherwise(F.substring("seq", 31, 30))
    body = F.array(_at(F.col("row") + 1, F.concat_ws(" ", _taxon(), F.substring("seq", 1, 30))), _at(F.col("n") + F.col("row") + 2, second))
    head = F.array(_at(F.lit(0), F.concat_ws(" ", "n", F.lit(_WIDTH))), _at(F.col("n") + 1, F.lit("")))
    return _counted(scan.scan_cells(_lines(rows, head, body)))


def _nexus_lines(rows):
    """Comments inside rows and over two lines, dashes at the end left out."""
    at = F.col("row") * 2
    row = F.concat(_taxon(), F.lit(" "), F.substring("seq", 1, 20), F.lit("[x;y]"), F.rtrim(F.translate(F.substring("seq", 21, 40), "-", " ")))
    noted = F.concat(row, F.lit(" [opens"))
    body = F.array(_at(at + 5, F.when(F.col("row") % 5 == 0, noted).otherwise(row)), _at(at + 6, F.when(F.col("row") % 5 == 0, "r7 CCC] ").otherwise("")))
    texts = [F.lit("#NEXUS"), F.lit("begin data;"), F.concat(F.lit("dimensions ntax="), "n", F.lit(f" nchar={_WIDTH};")), F.lit("format datatype=dna gap=-;"), F.lit("Matrix")]
    head = F.array(*[_at(F.lit(i), x) for i, x in enumerate(texts)], _at(F.col("n") * 2 + 6, F.lit(";")), _at(F.col("n") * 2 + 7, F.lit("end;")))
    return _lines(rows, head, body)


@register("scan_nexus", _DOC_CELLS)
def _(spark, d):
    return _counted(scan.scan_cells(_nexus_lines(_doc_rows(spark, d))))


@register("detect_formats", (
    _DOC_ROWS + "SELECT DISTINCT aln, CASE aln::BIGINT % 3 WHEN 0 THEN 'nexus' WHEN 1 THEN 'custom' ELSE 'phylip' END AS kind FROM c"
))
def _(spark, d):
    """One file a document, a third of them of each kind."""
    rows = _doc_rows(spark, d)
    third = F.col("aln").cast("bigint") % 3
    own = F.array(_at(F.lit(0), F.lit("")), _at(F.lit(1), F.concat_ws(" ", F.lit("#SPECIALALPHABET"), "n", F.lit(_WIDTH), F.lit("ACGT"))))
    plain = F.array(_at(F.lit(0), F.concat_ws(" ", "n", F.lit(_WIDTH))))
    lines = _nexus_lines(rows.filter(third == 0)).unionByName(_sequential_lines(rows.filter(third == 1), own)).unionByName(_sequential_lines(rows.filter(third == 2), plain))
    return scan.formats(lines).select("aln", "kind")


@register("convert_alignments", (
    _DOC_ROWS + f", r AS (SELECT aln, i // {_WIDTH} AS row, string_agg(ch, '' ORDER BY i) AS s FROM c GROUP BY 1, 2) "
    f"SELECT aln, 'r' || row AS taxon, rpad(s, {_WIDTH}, '-') AS seq FROM r"
))
def _(spark, d):
    """NEXUS to the rows of a FASTA or PHYLIP file."""
    cells = scan.scan_cells(_nexus_lines(_doc_rows(spark, d)))
    return sw.alignment_lines(cells, _WIDTH, ["aln"], in_rows=True)


@register("parse_draws", (
    "WITH o AS (SELECT o_orderstatus AS run, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS iter, o_totalprice AS p, o_custkey AS c FROM orders) "
    f"SELECT run, iter, {rnd('p', 'alpha', 3)}, 2::BIGINT AS ncomp, {rnd('c + 0.5', 'kappa', 3)}, 3::BIGINT AS n_sites, ((c % 2) + 1)::BIGINT AS comp_sum, "
    f"{rnd('0.25 + (c % 10) / 20.0', 'freq_x', 4)}, '(a:' || (c % 7) || ',b:1);' AS newick FROM o"
))
def _(spark, d):
    """Chain points with two components and three sites: one row a point from all its tables."""
    from cladeframe.functions.ordered import position_in_group

    orders = t.load(spark, d, "orders").select(F.col("o_orderstatus").alias("run"), "o_orderkey", F.col("o_totalprice").alias("p"), F.col("o_custkey").alias("c"))
    placed = position_in_group(orders, ["run"], ["o_orderkey"], F.floor(F.col("o_orderkey") / t.ORDER_BUCKET), "iter")
    share = 0.25 + (F.col("c") % 10) / 20
    numbers = F.concat_ws("\n", F.concat_ws(" ", F.col("p").cast("string"), F.lit("2"), (F.col("c") + 0.5).cast("string")), F.lit("1 2"),
                          F.concat_ws(" ", share.cast("string"), (1 - share).cast("string")), F.lit("0.5 0.5"), F.concat_ws(" ", (F.col("c") % 2).cast("string"), F.lit("0 1")))
    tree = F.concat(F.lit("(a:"), F.col("c") % 7, F.lit(",b:1)"))
    # a piece is what stands before a semicolon: the numbers of a point, then the tree of the next
    trees = placed.select("run", F.col("iter").alias("_piece"), F.lit(1).alias("o"), tree.alias("value"))
    points = placed.select("run", (F.col("iter") + 1).alias("_piece"), F.lit(0).alias("o"), numbers.alias("value"))
    texts = F.array_sort(F.collect_list(F.struct("o", "value")))
    pieces = trees.unionByName(points).groupBy("run", "_piece").agg(F.array_join(F.transform(texts, lambda x: x["value"]), "\n").alias("value"))
    parsed = sc.parse_draws(pieces, ["x", "y"], ("alpha",))
    key = ["run", "iter"]
    sites = parsed["alloc"].groupBy(*key).agg(F.count(F.lit(1)).alias("n_sites"), F.sum("comp").alias("comp_sum"))
    freq = parsed["profiles"].filter("comp = 0 AND state = 'x'").select(*key, F.col("freq").alias("freq_x"))
    out = parsed["draws"].join(sites, key).join(freq, key).join(parsed["trees"], key)
    return tidy(out, 3, freq_x=4)


@register("wide_table", (
    "SELECT l_suppkey AS supplier, " + ", ".join(f"round(sum(CASE WHEN l_returnflag = '{f}' THEN 1 ELSE 0 END) / count(*), 6) AS {f}" for f in "ANR")
    + " FROM lineitem GROUP BY 1"
))
def _(spark, d):
    """Return-flag shares of every supplier in the wide layout."""
    rows = t.lineitem(spark, d).groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("supplier").agg(F.sum("n").alias("t"))
    long = rows.join(totals, "supplier").select("supplier", "flag", F.round(F.col("n") / F.col("t"), 6).alias("share"))
    return sw.wide_table(long, "supplier", "flag", "share", t.FLAGS).fillna(0.0)
