"""Plans that must not sort, rescan or merge what grows with the input."""

from pyspark.sql import functions as F

from cladeframe import tables
from cladeframe.operators import codon
from cladeframe.operators import likelihood as lk
from cladeframe.plans import texts

DNA = "ACGT"


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_levels_deal_rows_by_site(spark, capsys, monkeypatch):
    nodes = spark.createDataFrame(
        [("root", None, None, None, 0), ("x", "root", None, 0.4, 1), ("A", "root", "a", 0.3, 1), ("B", "x", "b", 0.2, 2)],
        "node string, parent string, taxon string, length double, depth int",
    )
    cells = spark.createDataFrame([("a", i, "A") for i in range(40)] + [("b", i, "C") for i in range(40)], "taxon string, site bigint, state string")
    models = spark.createDataFrame([(0, i, 0, 0.7, [0.1, 0.2, 0.3, 0.4]) for i in range(40)], "draw bigint, site bigint, cat int, rate double, pi array<double>")
    monkeypatch.setattr(lk, "MODEL_ROWS_AT_ONCE", 2)  # twenty tasks, whatever the session's number is
    found = lk.site_loglik_levels(cells, nodes, models, list(DNA))
    assert plan(found, capsys).count("hashpartitioning(site") >= 1
    found.explain()
    assert ", 20), REPARTITION_BY_NUM" in capsys.readouterr().out
    want = {r.site: r.logl for r in lk.site_loglik(cells, nodes, models, list(DNA)).collect()}
    assert {r.site: round(r.logl, 9) for r in found.collect()} == {s: round(x, 9) for s, x in want.items()}


def test_codons_are_hashed_where_rows_unfold(spark, tmp_path, capsys):
    d = documents(spark, tmp_path, [(1, "abcdea"), (2, "a?c"), (3, None), (4, ""), (5, "ta")])
    found = codon.codons(tables.nuc_cells(spark, d))
    text = plan(found, capsys)
    assert "SortAggregate" not in text and text.count("Exchange") == 1  # the documents, not the cells
    got = {(r.taxon, r.site): r.state for r in found.collect()}
    # letters number 0, 1, 2, ... are A, C, G, T, A, ...; a cell that is missing leaves no codon
    assert got[1, 0] == "ACG" and got[2, 0] is None and got[5, 0] is None
    assert got == {(r.taxon, r.site): r.state for r in codon.codons_of_rows(tables.nuc_seqs(spark, d)).collect()}


def test_triples_are_cut_by_columns(spark, capsys):
    seqs = spark.createDataFrame([("a", list("ACGT")), ("b", []), ("c", None), ("d", ["A", None, "G"])], "taxon string, seq array<string>")
    found = codon.triples_of_rows(seqs)
    assert "lambdafunction" not in plan(found, capsys)
    assert sorted(map(tuple, found.collect()), key=str) == [("a", 0, "A", "C", "G"), ("a", 1, "T", None, None), ("d", 0, "A", None, "G")]


def test_rows_of_a_text_are_cut_in_one_pass(spark, tmp_path, capsys):
    d = documents(spark, tmp_path, [(1, "ab c" * 50), (2, "Z" * 60), (3, "?"), (4, None)])
    rows = texts._doc_rows(spark, d)
    assert "substring(" not in plan(rows.select("seq"), capsys)
    got = {(r.aln, r.row): (r.n, r.seq) for r in rows.collect()}
    letters = "ACG" * 50
    assert got == {
        ("1", 0): (3, letters[:60]), ("1", 1): (3, letters[60:120]), ("1", 2): (3, letters[120:].ljust(60, "-")), ("2", 0): (1, "C" * 60),
    }
    assert rows.schema["row"].dataType == rows.select(F.lit(0).cast("bigint")).schema[0].dataType


def test_rows_are_cut_above_the_shuffle_that_deals_them(spark, tmp_path, capsys):
    rows = [(1, "abcdea"), (2, "a?c"), (3, None), (4, ""), (5, "ta"), (5, "ta")]
    found = codon.codons_of_rows(tables.nuc_seqs(spark, documents(spark, tmp_path, rows)))
    text = plan(found, capsys)
    assert "RoundRobin" in text and "split(" not in text.split("RoundRobin")[1]
    empty = [(4, 0, None)] if any(r.taxon == 4 for r in found.collect()) else []
    want = [(1, 0, "ACG"), (1, 1, None), (2, 0, None), (5, 0, None), (5, 0, None), *empty]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_varying_codon_columns_are_found_in_one_pass(spark, tmp_path, capsys):
    # site 0 varies, site 1 has two codons of one acid (GCA, GCC), site 2 one codon and a missing cell, site 3 is missing, site 4 varies
    rows = [(1, "AAAGCAACG???AAA"), (2, "CCCGCCACG???CCC"), (3, "AAAGCA??????AAA"), (4, None)]
    texts_ = spark.createDataFrame(rows, "taxon int, text string")
    kept = codon.drop_aa_constant_sites(codon.codons_of_text(texts_))
    assert "SortAggregate" not in plan(kept, capsys)
    kept.explain()
    assert capsys.readouterr().out.count("regexp_extract_all") == 1  # the rows that stay; the columns are known by then
    got = sorted((r.taxon, r.site, r.state) for r in kept.collect())
    assert got == [(1, 0, "AAA"), (1, 1, "AAA"), (2, 0, "CCC"), (2, 1, "CCC"), (3, 0, "AAA"), (3, 1, "AAA")]
