"""Readers and writers on small files of our own."""

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import codon as cd
from cladeframe.sources import alignments as sa
from cladeframe.sources import chains as sc
from cladeframe.sources import scan
from cladeframe.sources import writers as sw

WANT = {"tax1": "ACGTAC", "tax2": "AC-TTT", "tax3": "GGGTAN"}
FILES = {
    "seq.phy": "3 6\ntax1  ACG\nTAC\ntax2 AC-TTT\ntax3 GG GTAN\n",
    "inter.phy": "3 6\ntax1 ACG\ntax2 AC-\ntax3 GGG\n\nTAC\nTTT\nTAN\n",
    "named.phy": "3 6\ntax1 ACG\ntax2 AC-\ntax3 GGG\n\ntax1 TAC\ntax2 TTT\ntax3 TAN\n",
    "m.nex": "#NEXUS\nbegin data;\ndimensions ntax=3 nchar=6;\nformat datatype=dna gap=-;\nMatrix\n[a comment]\ntax1 ACG[mid]TAC\ntax2 AC(AG)TTT\ntax3 GGGTA\n;\nend;\n",
    "own.ali": "#SPECIALALPHABET\n3 6 ACGT\ntax1 ACGTAC\ntax2 AC?TTT\ntax3 GGGTAX\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("aln")
    for name, text in FILES.items():
        (root / name).write_text(text)
    return str(root)


def seqs(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.aln, {})[r.taxon] = "".join(s or "-" for s in r.seq)
    return out


def test_all_formats(spark, folder):
    got = seqs(sa.read_alignments(spark, folder))
    want = {k: v.replace("N", "-") for k, v in WANT.items()}
    assert got == dict.fromkeys(FILES, want)
    cells = sa.to_cells(sa.read_alignments(spark, folder))
    assert cells.count() == 18 * len(FILES) and cells.filter(F.col("state").isNull()).count() == 2 * len(FILES)


def test_alphabet_and_errors():
    assert sa.parse_phylip("1 4\na ACDE\n")[0][1] == list("ACDE")
    assert sa.parse_phylip("1 4\na ACGU\n")[0][1] == list("ACGU")
    with pytest.raises(ValueError, match="unknown letters"):
        sa.parse("#SPECIALALPHABET 1 3 AB\na ABC\n")
    with pytest.raises(ValueError, match="found twice"):
        sa._translate([("a", "A"), ("a", "A")], {"A": "A"})
    with pytest.raises(ValueError):
        sa.parse("2 4\na ACGT\n")


def test_lines_of_any_size(spark, tmp_path):
    (tmp_path / "x.phy").write_text("3 6\ntax1  ACGTAC\ntax2  AC-TTT\ntax3  GGGTAN\n")
    got = seqs(sa.read_phylip_lines(spark, str(tmp_path), "dna"))
    assert got["x.phy"] == {k: v.replace("N", "-") for k, v in WANT.items()}


def test_write_and_convert(spark, folder, tmp_path):
    one = sa.to_cells(sa.read_alignments(spark, folder + "/seq.phy"))
    sw.write_phylip(one, str(tmp_path / "p"), 6)
    again = sa.to_cells(sa.read_phylip_lines(spark, str(tmp_path / "p"), "dna"))
    keys = ["taxon", "site", "state"]
    assert sorted(map(str, again.select(keys).collect())) == sorted(map(str, one.select(keys).collect()))
    sw.write_fasta(one, str(tmp_path / "f"), 6)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "f")).collect())
    assert ">tax2" in text and "AC-TTT" in text
    codons = cd.codons(one.select(keys))
    sw.write_phylip(codons, str(tmp_path / "c"), 2, width=3)
    lines = [r.value for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert lines[0] == "3 6" and "tax2  ---TTT" in lines
    sa.convert_alignments(spark, folder, str(tmp_path / "all"), to="phylip")
    back = seqs(sa.read_alignments(spark, str(tmp_path / "all" / "aln=m.nex")))
    assert list(back.values()) == [{k: v.replace("N", "-") for k, v in WANT.items()}]
    sa.convert_alignments(spark, folder, str(tmp_path / "fa"), to="fasta")
    assert spark.read.text(str(tmp_path / "fa")).filter("value like '>%'").count() == 3 * len(FILES)


def test_trees_keep_file_order(spark, tmp_path):
    for run in ("one", "two"):
        (tmp_path / f"{run}.treelist").write_text("".join(f"(a:{i},b:1,\n c:1);\n" for i in range(25)))
    got = sc.read_trees(spark, str(tmp_path)).orderBy("run", "iter").collect()
    assert [r.iter for r in got] == [*range(25), *range(25)]
    assert [r.newick for r in got if r.run == "one"] == [f"(a:{i},b:1,c:1);" for i in range(25)]


def test_record_numbers_across_splits(spark, tmp_path):
    """A file cut into many splits numbers its records as one file."""
    (tmp_path / "big.treelist").write_text("".join(f"(a:{i},b:1);\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = sc.read_trees(spark, str(tmp_path))
        assert df.filter(F.col("newick") == F.format_string("(a:%d,b:1);", "iter")).count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_traces_and_scores(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "run1.trace").write_text("iter\ttime\ttopo\tloglik\talpha\n" + "".join(f"{i}\t0\t0\t-{i}.5\t0.{i}\n" for i in range(5)))
    got = sc.read_traces(spark, str(tmp_path / "t"))
    assert sorted({r.param for r in got.collect()}) == ["alpha", "loglik"]
    assert {(r.iter, r.value) for r in got.filter("param = 'loglik'").collect()} == {(i, -i - 0.5) for i in range(5)}
    (tmp_path / "a.sitelogl").write_text("site\tlogl\tvar\tlogcpo\tess\tlogpostmeanl\tess\n1\t-2\t0.1\t-2.1\t9\t-1.9\t8\n")
    r = sc.read_site_scores(spark, str(tmp_path / "a.sitelogl")).first()
    assert (r.run, r.site, r.ess_cpo, r.logpostmeanl, r.ess_l) == ("a", 1, 9.0, -1.9, 8.0)
    (tmp_path / "b.stepping").write_text("0\t0\t-1.5\t-2\t0\t0.3\t100\t50\n0\t1\t-1.6\t-2\t0\t0.3\t100\t40\t1\t2\t3\t4\t5\t6\n")
    s = sc.read_stepping(spark, str(tmp_path / "b.stepping")).orderBy("cycle").collect()
    assert [(x.cycle, x.logz, x.npoint, x.pilot_ess) for x in s] == [(0, -1.5, 100, None), (1, -1.6, 100, 6.0)]
    (tmp_path / "c.cvsitelogl").write_text("-1 -2 -3\n-4 -5 -6\n")
    m = {(x.iter, x.site): x.logl for x in sc.read_site_logl(spark, str(tmp_path / "c.cvsitelogl")).collect()}
    assert m[0, 2] == -3 and m[1, 0] == -4 and len(m) == 6


def test_small_tables(spark, tmp_path):
    (tmp_path / "genes").write_text("2\n1 1 10\n2 11 25\n")
    assert [tuple(r) for r in sc.read_genes(spark, str(tmp_path / "genes")).collect()] == [(1, 1, 10), (2, 11, 25)]
    (tmp_path / "excl").write_text("2\n4 7\n")
    assert [r.gene for r in sc.read_exclusions(spark, str(tmp_path / "excl")).collect()] == [4, 7]
    (tmp_path / "mix.txt").write_text("3\nA C G\n2\n1 0.5 0.25 0.25\n3 2 0 2\n")
    rows = {(r.comp, r.state): (r.weight, r.freq) for r in sc.read_mixture(spark, str(tmp_path / "mix.txt"), 0.1).collect()}
    assert rows[0, "A"] == (0.25, 0.5) and rows[1, "C"] == (0.75, pytest.approx(0.1 / 4.1))
    (tmp_path / "p.posthyper").write_text("2.5\t4\n\n1\t2\n3\t4\n\n0.1\t0.2\t0.7\n")
    hyper = sc.read_posthyper(spark, str(tmp_path / "p.posthyper")).orderBy("line").collect()
    assert [(r.shape, r.rate) for r in hyper] == [(2.5, 4.0), (1.0, 2.0), (3.0, 4.0)]


def test_chain_points(spark, tmp_path):
    def point(i):
        profiles = "".join(f"0.{i}\t0.{9 - i}\n" for _ in range(i + 1))
        return f"(a:{i},b:1);\n1\t\n2\n0.{i + 1}\n{i + 1}\n7.5\n0.4\t0.6\t\n\n{profiles}" + "\t".join(["0"] * 3) + "\t\n\n"

    (tmp_path / "r1.chain").write_text("".join(point(i) for i in range(4)))
    got = sc.read_draws(spark, str(tmp_path), ["x", "y"])
    draws = got["draws"].orderBy("iter").collect()
    assert [(r.iter, r.ncomp, r.alpha, r.kappa) for r in draws] == [(i, i + 1, pytest.approx((i + 1) / 10), 7.5) for i in range(4)]
    assert [r.newick for r in got["trees"].orderBy("iter").collect()] == [f"(a:{i},b:1);" for i in range(4)]
    assert got["profiles"].count() == 2 * (1 + 2 + 3 + 4)
    assert got["alloc"].count() == 12 and got["dirweight"].filter("state = 'y'").first().value == 0.6
    sc.write_draws(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "profiles")).filter("run = 'r1' and iter >= 2").count() == 14


def test_tables(spark, tmp_path):
    long = spark.createDataFrame([(s, k, s + i / 10) for s in (1, 2) for i, k in enumerate("AC")], "site int, state string, freq double")
    wide = sw.wide_table(long, "site", "state", "freq", ["A", "C"])
    sw.write_table(wide.orderBy("site").coalesce(1), str(tmp_path / "w"), "tab")
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["site\tA\tC", "1\t1.0\t1.1", "2\t2.0\t2.1"]
    sw.write_table(long, str(tmp_path / "p"), partition_by=["site"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    with pytest.raises(ValueError, match="layout"):
        sw.write_table(long, str(tmp_path / "q"), "latex")


def observed(df):
    return sorted((r.aln, r.taxon, r.site, r.state) for r in df.filter(F.col("state").isNotNull()).collect())


@pytest.mark.parametrize("size", ["16", "1m"])
def test_scan_in_ranges(spark, folder, size):
    """Files cut anywhere give the cells of the readers of whole files."""
    want = observed(sa.to_cells(sa.read_alignments(spark, folder)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert observed(scan.scan_alignments(spark, folder)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_scan_notices_wrong_files(spark):
    texts = {
        "short.phy": "2 4\na ACG\nb ACGT\n", "letters.ali": "#SPECIALALPHABET 1 3 AB\na ABC\n", "twice.phy": "2 2\na AC\na AC\n",
        "taxa.nex": "#NEXUS\ndimensions ntax=2 nchar=2;\nformat datatype=dna;\nmatrix\na AC\n;\n", "odd.phy": "1 2\na J!\n",
    }
    for name, text in texts.items():
        lines = spark.createDataFrame([(name, 0, i, v) for i, v in enumerate(text.split("\n"))], "aln string, part bigint, line bigint, value string")
        with pytest.raises(Exception, match="sizes|unknown letter|twice|wrong number|no alphabet"):
            scan.scan_cells(lines.coalesce(1)).collect()


def test_range_reports_agree_with_reading():
    import random

    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        n_sites = rng.randrange(1, 9)
        words = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 14))]
        told = {need: rest for need, *rest in scan.range_report(np.array(words), n_sites)}
        for start in range(n_sites + 1):
            need, names = start, 0
            for w in words:
                if need == 0:
                    need, names = n_sites, names + 1
                else:
                    need -= w
                if need < 0:
                    break
            crossed = start in told
            if need < 0:
                assert not crossed
            elif start > sum(words):
                assert not crossed and need == start - sum(words)
            else:
                assert told[start] == [need, names]


def test_lines_of_cells_in_rows(spark):
    """Runs of cells give the lines that single cells give, whatever repeats, overlaps or is null."""
    import random

    rng = random.Random(5)
    rows = [(f"f{f}", f"r{r}", i, rng.choice(["A", "C", "G", None])) for f in range(4) for r in range(5) for i in range(rng.randrange(1, 40))]
    rows += [("f0", "r0", i, "T") for i in range(5, 9)] + [("f1", "r1", 3, "GG"), ("f1", "r1", 4, "é"), ("f1", "r1", 5, "")]
    rows += [("f2", "r2", None, "A"), ("f2", None, 1, "A"), (None, None, 1, "C"), ("f3", "void", 0, None), ("f3", "void", None, None)]
    for order in (rows, rng.sample(rows, len(rows))):
        for width in (1, 3):
            cells = spark.createDataFrame(order, "aln string, taxon string, site bigint, state string").repartition(3).union(spark.createDataFrame(order[:9], "aln string, taxon string, site bigint, state string"))
            want = sw.alignment_lines(cells, 45, ["aln"], width)
            got = sw.alignment_lines(cells, 45, ["aln"], width, in_rows=True)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    one = spark.createDataFrame([("a", 7, i, "ACG"[i % 3]) for i in range(30)], "aln string, taxon int, site int, state string").coalesce(1)
    runs = sw.cell_runs(one, ["aln", "taxon"])
    assert [(r.aln, r.taxon, r.start, r.text, r.n, r.w) for r in runs.collect()] == [("a", 7, 0, "ACG" * 10, 30, 1)]


def test_lines_are_packed_once_by_range(spark):
    """Ranges keep their lines in order and are cut when they are long; blank lines and lines of no file go."""
    rows = [("a", 0, i, f"x{i}") for i in range(scan.RANGE_LINES + 3)] + [("a", 1, 0, "y"), ("a", 1, 1, "  "), ("b", 0, 0, None), (None, 0, 0, "z")]
    lines = spark.createDataFrame(rows, "aln string, part bigint, line bigint, value string").repartition(4)
    got = {(r.aln, r.part.part, r.part.sub): r.lines for r in scan.packed_ranges(lines).collect()}
    assert got == {("a", 0, 0): [f"x{i}" for i in range(scan.RANGE_LINES)], ("a", 0, 1): [f"x{scan.RANGE_LINES + i}" for i in range(3)], ("a", 1, 0): ["y"]}


def _texts(rng, kind, n_taxa, n_sites):
    """An alignment and its text of a kind, with breaks, comments and blanks at random places."""
    rows = {f"t{i}": "".join(rng.choice("ACGTacgt-?N") for _ in range(n_sites)) for i in range(n_taxa)}

    def cut(s):
        at = sorted(rng.sample(range(1, len(s)), rng.randrange(0, 3))) if len(s) > 3 else []
        return [s[a:b] for a, b in zip([0, *at], [*at, len(s)], strict=True)]

    if kind == "sequential":
        return rows, f"{n_taxa} {n_sites}\n" + "".join(f"{t}{rng.choice([' ', chr(10)])}{rng.choice([' ', chr(10), chr(9)]).join(cut(s))}\n" for t, s in rows.items())
    if kind == "custom":
        rows = {t: s.replace("N", "X") for t, s in rows.items()}
        head = rng.choice([f"#SPECIALALPHABET\n{n_taxa} {n_sites} ACGTacgt", f"\n#SPECIALALPHABET {n_taxa} {n_sites} ACGTacgt"])
        return rows, head + "\n" + "".join(f"{t} {chr(10).join(cut(s))}\n\n" for t, s in rows.items())
    if kind == "interleaved":
        half = n_sites // 2
        again = rng.random() < 0.5
        return rows, f"{n_taxa} {n_sites}\n" + "".join(f"{t} {s[:half]}\n" for t, s in rows.items()) + "\n" + "".join((f"{t} " if again else "") + s[half:] + "\n" for t, s in rows.items())
    notes = ["", "[n]", "[two\nlines t0 AC;\n matrix]", "[a [b]"]
    body = "".join(f"{t} {rng.choice(['', '[n]', '[a [b]'])}{part}\n{rng.choice(notes)}\n" for k in range(2) for t, s in rows.items() for part in [s[k * n_sites // 2:(k + 1) * n_sites // 2]])
    return rows, f"#NEXUS [matrix\n;] \nbegin data;\ndimensions ntax={n_taxa}\n nchar={n_sites};\nformat datatype=dna;\n{rng.choice(notes)}\n Matrix\n{body};\nt0 AAAA\nend;\n"


@pytest.mark.parametrize("kind", ["sequential", "custom", "interleaved", "nexus"])
def test_ranges_agree_with_whole_files(spark, kind):
    """Files in ranges of every length give the states written, a row per letter."""
    import random

    rng = random.Random(kind)
    rows, want = [], []
    for f in range(24):
        made, text = _texts(rng, kind, rng.randrange(1, 9), rng.randrange(8, 30))
        step = rng.choice([1, 2, 3, 5, 100])
        rows += [(f, i // step, i, v) for i, v in enumerate(text.split("\n"))]
        up = (lambda s: s) if kind == "custom" else str.upper
        want += [(f, t, i, None if c in "-?NX" else up(c)) for t, s in made.items() for i, c in enumerate(s)]
    rng.shuffle(rows)
    got = scan.scan_cells(spark.createDataFrame(rows, "aln bigint, part bigint, line bigint, value string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kind", ["sequential", "custom", "interleaved", "nexus"])
def test_lines_are_read_once(spark, kind):
    """Whatever the format needs to know first, every line is made once."""
    import random

    rng, made = random.Random(3), spark.sparkContext.accumulator(0)
    rows = [(str(f), i // 4, i, v) for f in range(5) for i, v in enumerate(_texts(rng, kind, 4, 20)[1].split("\n"))]
    schema = "aln string, part bigint, line bigint, value string"

    def told(row):
        made.add(1)
        return row

    lines = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(told), schema)
    assert scan.scan_cells(lines).count() == 5 * 4 * 20
    assert made.value == len(rows)


def test_a_header_that_stands_twice_is_left_out(spark):
    """Lines at the place of the header belong to it; rows that come twice contradict the sizes."""
    rows = [("a", 0, 0, "#SPECIALALPHABET"), ("a", 0, 0, "#SPECIALALPHABET"), ("a", 0, 1, "2 3 AB"), ("a", 0, 2, "x ABA"), ("a", 0, 3, "y BBB")]
    schema = "aln string, part bigint, line bigint, value string"
    assert scan.scan_cells(spark.createDataFrame(rows, schema)).count() == 6
    with pytest.raises(Exception, match="sizes"):
        scan.scan_cells(spark.createDataFrame([*rows, *rows[2:]], schema)).collect()
