"""Hand-made cases and properties with values worked out outside Spark."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import newick as nw
from cladeframe.functions.alphabets import DNA, alphabet, genetic_code, pair_index, sense_codons
from cladeframe.functions.gamma import category_rates
from cladeframe.functions.logspace import log_moments, weighted_log_sum
from cladeframe.functions.ordered import next_in_group, order_statistics, position_in_group
from cladeframe.functions.student import critical_value
from cladeframe.operators import alignment as al
from cladeframe.operators import codon as cd
from cladeframe.operators import fit
from cladeframe.operators import likelihood as lk
from cladeframe.operators import messages
from cladeframe.operators import mutsel as ms
from cladeframe.operators import splits as sp
from cladeframe.operators import trace as tr
from cladeframe.operators import trees as tt


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 4 taxa x 12 nucleotides: site 3 all missing, site 0 constant, TAA in taxon d, an N in taxon b
ALIGNMENT = {"a": "ATG-CCGATTTA", "b": "ATGNCAGATTTG", "c": "AAG-CCGATTTT", "d": "ATC-TAGCTTAA"}


@pytest.fixture(scope="module")
def cells(spark):
    raw = [("x", t, i, c) for t, s in ALIGNMENT.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(raw, "aln string, taxon string, site int, symbol string")
    return al.encode_states(df, alphabet(spark, "dna")).select("taxon", "site", "state")


def test_site_predicates(cells):
    assert rows(al.all_missing_sites(cells)) == [(3,)]
    constant = {i for i in range(12) if len({s[i] for s in ALIGNMENT.values()} - set("-N")) <= 1}
    assert {r[0] for r in al.constant_sites(cells).select("site").collect()} == constant
    kept = al.drop_constant_sites(cells)
    assert {r[0] for r in kept.select("site").distinct().collect()} == set(range(12 - len(constant)))
    counts = al.constant_site_counts(cells).first()
    assert (counts.eliminated, counts.all_missing) == (len(constant) - 1, 1)


def test_unknown_letter_raises(spark):
    df = spark.createDataFrame([("a", 0, "!")], "taxon string, site int, symbol string")
    with pytest.raises(Exception, match="unknown state letter"):
        al.encode_states(df, alphabet(spark, "dna")).collect()


def test_codons(cells):
    got = {(r.taxon, r.site): r.state for r in cd.codons(cells, n_sites=12).collect()}
    assert got["a", 0] == "ATG" and got["a", 1] is None and got["b", 1] is None
    assert got["d", 3] is None and got["a", 3] == "TTA"
    translated = {(r.taxon, r.site): r.state for r in cd.translate(cd.codons(cells)).collect()}
    assert translated["a", 0] == "M" and translated["a", 3] == "L"
    with pytest.raises(ValueError, match="multiple of 3"):
        cd.codons(cells, n_sites=11)


def test_code_tables(spark):
    assert [len(sense_codons(c)) for c in ("universal", "mtmam", "mtinv")] == [61, 60, 62]
    steps = cd.codon_neighbours(genetic_code(spark))
    assert steps.count() == 526
    deg = {r.codon: r.degeneracy for r in cd.degeneracy(genetic_code(spark)).collect()}
    assert deg["GGA"] == 4 and deg["ATG"] == 1 and deg["ATA"] == 3
    near = {(r.aa_from, r.aa_to): r.non_ct for r in cd.non_ct_nearest(genetic_code(spark)).collect()}
    assert near["F", "L"] == 0 and near["M", "W"] == -1 and near["M", "K"] == 1
    pairs = spark.createDataFrame([(i, j) for i in range(5) for j in range(i + 1, 5)], "i int, j int")
    assert [r[0] for r in pairs.orderBy("i", "j").select(pair_index(F.col("j"), F.col("i"), 5)).collect()] == list(range(10))


def reference_ess(x):
    n = len(x)
    if min(x) == max(x):
        return float(n)
    y = np.array(x) - np.mean(x)
    cov = [float((y[: n - t] * y[t:]).sum()) / n for t in range(n // 2)]
    total = 1 + sum(2 * 0.5 * (1 + math.cos(2 * math.pi * t / n)) * cov[t] / cov[0] for t in range(1, n // 2))
    return float(n) if total < 1 else n / total


def test_effective_size(spark):
    rng = random.Random(1)
    series = {
        "constant": [2.5] * 9,
        "alternating": [1.0, -1.0] * 20,
        "five": [1.0, 4.0, 2.0, 8.0, 5.0],
        "walk": list(np.cumsum([rng.gauss(0, 1) for _ in range(157)])),
        "two": [1.0, 2.0],
    }
    data = [(name, i, "p", float(v)) for name, xs in series.items() for i, v in enumerate(xs)]
    trace = spark.createDataFrame(data, "run string, iter bigint, param string, value double")
    for short in (1 << 16, 8):
        got = {r.run: r.ess for r in tr.effective_size(trace, short=short).collect()}
        for name, xs in series.items():
            assert got[name] == pytest.approx(reference_ess(xs), rel=1e-9), (name, short)
    assert got["alternating"] == 40.0


def test_trace_windows():
    assert tr.default_window(100) == (20, 100)
    assert tr.default_window(100, -10) == (10, 100)
    assert tr.default_window(100, 7, 50) == (7, 50)


def test_log_moments_have_no_underflow(spark):
    values = {1: [-1000.0, -1001.5, -998.0], 2: [-3.0] * 5, 3: [-2000.0, 0.5, 700.0], 4: [255.9, 256.1]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k int, v double")
    got = {r.k: r for r in log_moments(df, ["k"], "v").collect()}
    for k, vs in values.items():
        x = np.array(vs)
        up, down = np.exp(x - x.max()), np.exp(x.min() - x)
        assert got[k].log_mean_exp == pytest.approx(x.max() + math.log(up.mean()), rel=1e-12)
        assert got[k].log_harmonic == pytest.approx(x.min() - math.log(down.mean()), rel=1e-12)
        assert got[k].ess == pytest.approx(up.sum() ** 2 / (up**2).sum())
        assert got[k].var == pytest.approx(x.var(), abs=1e-7)
    assert got[2].ess == pytest.approx(5.0)
    w = df.withColumn("w", F.lit(0.25))
    s = {r.k: r.s for r in weighted_log_sum(w, ["k"], "v", "w", "s").collect()}
    assert s[1] == pytest.approx(-998 + math.log(0.25 * (math.exp(-2) + math.exp(-3.5) + 1)))


def test_student_values():
    known = {1: 12.7062047362, 2: 4.30265272975, 5: 2.57058183661, 30: 2.04227245630, 1000: 1.96233908083}
    for df, value in known.items():
        assert critical_value(df) == pytest.approx(value, rel=1e-9)


def test_gamma_categories():
    assert category_rates(np.array([0.5]), 4)[0] == pytest.approx([0.033388, 0.251916, 0.820268, 2.894428], abs=1e-6)
    assert category_rates(np.array([0.1, 1.0, 50.0]), 8).sum(1) == pytest.approx([8, 8, 8])


def test_curve_sizes():
    ks = [k for k, _ in fit.curve_sizes(350)]
    assert ks == [*range(1, 12), *range(21, 102, 10), 201, 301]
    assert dict(fit.curve_sizes(350))[3] == 1000 * 350 // 3


def test_ordered_helpers_on_a_hot_key(spark):
    """One key holds most rows; the results equal plain windows."""
    rng = random.Random(3)
    data = [(1 if rng.random() < 0.7 else rng.randrange(9), i, float(rng.randrange(40))) for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k int, at int, v double").repartition(7)
    cut = F.floor(F.col("at") / 50)
    placed = {(r.k, r.at): r.pos for r in position_in_group(df, ["k"], ["at"], cut, "pos").collect()}
    nxt = {(r.k, r.at): r.nxt for r in next_in_group(df, ["k"], ["at"], cut, {"nxt": "v"}).collect()}
    ranks = {"lo": F.floor(0.025 * F.col("n")), "hi": F.col("n") - 1, "mid": F.floor(F.col("n") / 2)}
    stats = {r.k: r for r in order_statistics(df, ["k"], "v", ranks, 16).collect()}
    for k in {d[0] for d in data}:
        own = sorted((at, v) for kk, at, v in data if kk == k)
        assert [placed[k, at] for at, _ in own] == list(range(len(own)))
        assert [nxt[k, at] for at, _ in own] == [v for _, v in own[1:]] + [None]
        vs = sorted(v for _, v in own)
        assert (stats[k].lo, stats[k].mid, stats[k].hi) == (vs[int(0.025 * len(vs))], vs[len(vs) // 2], vs[-1])


NEWICKS = {
    "rooted": "((a:1,b:1):0.5,((c:1,d:2):0.25,e:1):0.5);",
    "unrooted": "(a:1,b:1,((c:1,d:2):0.25,e:1):1.0);",
    "polytomy": "(a:1,b:1,c:1,d:2,e:1);",
    "support": "((a:1,b:1)97:0.5,(c:1,d:2)55:0.25,e:1);",
    "missing": "((a:1,b:1):0.5,(c:1,d:2):0.25);",
    "extra": "((a:1,b:1):0.5,(c:1,d:2):0.25,(e:1,f:3):0.125);",
}


@pytest.fixture(scope="module")
def trees(spark):
    return spark.createDataFrame([("r", i, t) for i, t in enumerate(NEWICKS.values())], "run string, iter bigint, newick string")


def splits_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(list(NEWICKS)[r.iter], {})["".join(r.split)] = r.length
    return out


def test_tree_splits(trees):
    got = splits_of(tt.tree_splits(trees))
    assert got["rooted"] == got["unrooted"] == {"b": 1, "c": 1, "d": 2, "e": 1, "cd": 0.25, "cde": 1.0, "bcde": 1}
    assert set(got["polytomy"]) == {"b", "c", "d", "e", "bcde"}
    assert got["missing"]["cd"] == 0.75
    support = {"".join(r.split): r.weight for r in tt.tree_splits(trees, with_support=True).filter("iter = 3").collect()}
    assert support["cde"] == 97 and support["cd"] == 55


def test_tree_edits_keep_lengths(trees):
    before = {r.iter: r.length for r in tt.tree_stats(tt.tree_nodes(trees), ["iter"]).collect()}
    for edited in (tt.unroot(trees), tt.reroot(trees, ["a"]), tt.reroot(trees, ["d"])):
        after = {r.iter: r.length for r in tt.tree_stats(tt.tree_nodes(edited), ["iter"]).collect()}
        assert after == pytest.approx(before)
    assert splits_of(tt.tree_splits(tt.reroot(trees, ["d"]))) == splits_of(tt.tree_splits(trees))
    root, rooted = nw.reroot(nw.parse(NEWICKS["rooted"]), {"c", "d"})
    assert rooted
    assert {c.length for c in root.children} == {0.125}
    kept, rooted = nw.reroot(nw.parse(NEWICKS["rooted"]), {"a", "c"})
    assert not rooted and nw.render(kept) == nw.render(nw.unroot(nw.parse(NEWICKS["rooted"])))


def test_prune(trees):
    kept = {r.iter: r.newick for r in tt.prune_taxa(trees, ["a", "d", "e"]).collect()}
    assert kept[0] == "(a:1.5,(d:2.25,e:1):0.5);"
    assert kept[4] == "(a:1.5,d:2.25);"


def test_node_tables(spark, trees):
    nodes = tt.tree_nodes(trees).filter("iter = 0")
    text = tt.to_newick(nodes.drop("support"), ["run", "iter"], 2).first().newick
    assert text == "((a:1.00,b:1.00):0.50,((c:1.00,d:2.00):0.25,e:1.00):0.50);"
    labels = {r.node: (r.leftmost, r.rightmost) for r in tt.mrca_labels(nodes, ["run", "iter"]).collect()}
    assert labels[0] == ("a", "e") and labels[4] == ("c", "e")
    depths = {r.node: (r.height, r.size, r.path) for r in tt.node_depths(nodes, ["run", "iter"]).collect()}
    assert depths[0] == (3, 5, pytest.approx(2.75))
    single = nodes.select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), "taxon", "length", "depth")
    with pytest.raises(Exception, match="taxon not in the tree: z"):
        tt.register_tree(single, spark.createDataFrame([("z",), ("a",)], "taxon string")).collect()


def test_newick_text_forms():
    assert nw.render(nw.parse("( a , (b:1e-3, c)0.9 :2 ) ;")) == "(a,(b:0.001,c)0.9:2);"
    with pytest.raises(ValueError, match="unbalanced"):
        nw.parse("((a,b);")


def brute_consensus(freq, cutoff):
    kept = []
    for split, p in sorted(freq.items(), key=lambda x: (-x[1], sorted(x[0]))):
        s = set(split)
        if p >= cutoff and all(not (s & k) or s <= k or k <= s for k in kept):
            kept.append(s)
    return sorted("".join(sorted(s)) for s in kept)


def test_consensus_blocks(spark, monkeypatch):
    """Small blocks give the same answer as one plain loop, the index the same conflicts as all pairs."""
    rng = random.Random(5)
    freq = {}
    while len(freq) < 60:
        s = tuple(sorted(rng.sample("bcdefghij", rng.randrange(1, 9))))
        freq[s] = rng.choice([0.02, 0.05, 0.1, 0.2, 0.3, 0.4])
    monkeypatch.setattr(sp, "BLOCK", 7)
    data = [(list(s), round(p * 100), p, 1.0) for s, p in freq.items()]
    merged = spark.createDataFrame(data, "split array<string>, n bigint, prob double, mean_length double")
    got = sorted("".join(r.split) for r in sp.consensus_splits(merged, 0.05).collect())
    assert got == brute_consensus(freq, 0.05)
    clashes = {("".join(r.split), "".join(r.split_b)) for r in sp.split_conflicts(merged, merged).collect()}
    want = {("".join(a), "".join(b)) for a in freq for b in freq if set(a) & set(b) and set(a) - set(b) and set(b) - set(a)}
    assert clashes == want


def test_consensus_tree(spark, trees):
    taxa = spark.createDataFrame([(x,) for x in "abcde"], "taxon string")
    same = trees.filter("iter in (0, 1, 3)")
    counts = sp.tree_counts(same)
    merged = sp.merge_runs(sp.split_freq(tt.tree_splits(same), counts), counts)
    nodes = tt.with_depth(sp.consensus_nodes(sp.consensus_splits(merged, 0.5), taxa)).withColumn("t", F.lit(1))
    text = tt.to_newick(nodes, ["t"], 3).first().newick
    assert text == "(a:1.000,b:1.000,((c:1.000,d:2.000)1.00:0.250,e:1.000)1.00:0.833);"


def test_splits_on_shared_taxa(spark, trees):
    shared = F.array(*[F.lit(x) for x in "abcd"])
    listed = sp.restricted_freq(tt.tree_splits(trees), sp.tree_counts(trees), shared)
    got = {"".join(r.split): r.support for r in sp.split_support(listed, listed).collect()}
    assert set(got) == {"b", "c", "d", "cd", "bcd"}


def brute_logl(tree, states, pi, rate, q=None):
    """Sum over all inner states by recursion on a nested tuple tree (children or leaf, length)."""
    k = len(pi)

    def p(t):
        if q is None:
            stay = math.exp(-rate * t)
            return stay * np.eye(k) + (1 - stay) * np.ones((k, 1)) * np.array(pi)
        out, term = np.eye(k), np.eye(k)
        for i in range(1, 80):
            term = term @ q * (rate * t) / i
            out = out + term
        return out

    def down(node):
        sub, t = node
        if isinstance(sub, str):
            v = np.ones(k) if states[sub] is None else np.eye(k)[states[sub]]
        else:
            v = np.prod([down(c) for c in sub], axis=0)
        return p(t) @ v

    like = float(np.array(pi) @ np.prod([down(c) for c in tree], axis=0))
    return math.log(like) if like > 0 else -math.inf


TREE = (("a", 0.3), ((("b", 0.2), ("c", 0.0)), 0.4), ("d", 1.1))
TREE_NODES = [
    ("root", None, None, None, 0), ("x", "root", None, 0.4, 1), ("A", "root", "a", 0.3, 1),
    ("D", "root", "d", 1.1, 1), ("B", "x", "b", 0.2, 2), ("C", "x", "c", 0.0, 2),
]


@pytest.fixture(scope="module")
def small_tree(spark):
    return spark.createDataFrame(TREE_NODES, "node string, parent string, taxon string, length double, depth int")


def test_site_loglik_against_brute_force(spark, small_tree, monkeypatch):
    rng = random.Random(2)
    pi = [0.1, 0.2, 0.3, 0.4]
    columns = [{x: rng.choice([0, 1, 2, 3, None]) for x in "abcd"} for _ in range(12)] + [dict.fromkeys("abcd")]
    cells = spark.createDataFrame(
        [(x, i, DNA[s]) for i, c in enumerate(columns) for x, s in c.items() if s is not None], "taxon string, site bigint, state string"
    )
    models = [(dr, i, cat, r, pi) for dr in (0, 100) for i in range(len(columns)) for cat, r in enumerate((0.5, 2.0))]
    table = spark.createDataFrame(models, "draw bigint, site bigint, cat int, rate double, pi array<double>")
    want = {(d, i, c): brute_logl(TREE, columns[i], pi, r) for d, i, c, r, _ in models}
    for form, room in ((lk.site_loglik, 4096), (lk.site_loglik, 6), (lk.site_loglik_levels, 6)):
        monkeypatch.setattr(messages, "BLOCK_ROWS", room)
        monkeypatch.setattr(messages, "LEAVES_AT_ONCE", 256 if room > 6 else 1)
        monkeypatch.setattr(messages, "MESSAGES_AT_ONCE", 16 if room > 6 else 2)
        got = {(r.draw, r.site, r.cat): r.logl for r in form(cells, small_tree, table, DNA).collect()}
        assert got == pytest.approx(want), form.__name__
    shared = table.filter("site = 0").drop("site")  # the same models for every site with data
    got = {(r.draw, r.site, r.cat): r.logl for r in lk.site_loglik(cells, small_tree, shared, DNA).collect()}
    assert got == pytest.approx({key: x for key, x in want.items() if any(s is not None for s in columns[key[1]].values())})
    exch = [1.0, 2.0, 0.5, 0.7, 3.0, 1.3]
    upper = np.zeros((4, 4))
    upper[np.triu_indices(4, 1)] = exch
    q = (upper + upper.T) * np.array(pi)
    np.fill_diagonal(q, -q.sum(1))
    reversible = table.withColumn("rr", F.array(*[F.lit(x) for x in exch]))
    got = {(r.draw, r.site, r.cat): r.logl for r in lk.site_loglik(cells, small_tree, reversible, DNA).collect()}
    want = {(d, i, c): brute_logl(TREE, columns[i], pi, r, q) for d, i, c, r, _ in models}
    assert got == pytest.approx(want, abs=1e-9)
    ones = table.withColumn("rr", F.array(*[F.lit(1.0)] * 6))
    equal = {(r.draw, r.site, r.cat): r.logl for r in lk.site_loglik(cells, small_tree, ones, DNA).collect()}
    plain = {(r.draw, r.site, r.cat): r.logl for r in lk.site_loglik(cells, small_tree, table, DNA).collect()}
    assert equal == pytest.approx(plain, abs=1e-9)


def test_ancestral_probs_against_brute_force(spark, small_tree):
    """Clamping an inner node to each state with an extra zero-length leaf gives its posterior."""
    pi = [0.1, 0.2, 0.3, 0.4]
    column = {"a": 0, "b": 1, "c": 3, "d": 3}
    cells = spark.createDataFrame([(x, 0, DNA[s]) for x, s in column.items()], "taxon string, site bigint, state string")
    models = spark.createDataFrame([(0, 0, 0, 0.7, pi)], "draw bigint, site bigint, cat int, rate double, pi array<double>")
    got = {(r.node, r.state): r.prob for r in lk.ancestral_probs(cells, small_tree, models, DNA).collect()}
    joint = {}
    for s in range(4):
        clamped = (("a", 0.3), ((("b", 0.2), ("c", 0.0), ("e", 0.0)), 0.4), ("d", 1.1))
        joint["x", s] = math.exp(brute_logl(clamped, {**column, "e": s}, pi, 0.7))
        joint["root", s] = math.exp(brute_logl((*TREE, ("e", 0.0)), {**column, "e": s}, pi, 0.7))
    for node in ("x", "root"):
        total = sum(joint[node, s] for s in range(4))
        for s in range(4):
            assert got[node, DNA[s]] == pytest.approx(joint[node, s] / total, abs=1e-9)


def test_messages_stay_in_their_block(spark, small_tree, monkeypatch):
    """Small trees need no message outside a task; larger ones, level by level, give the same."""
    rng = random.Random(6)
    columns = [{x: rng.choice([0, 1, 2, 3, None]) for x in "abcd"} for _ in range(9)]
    cells = spark.createDataFrame([(x, i, DNA[s]) for i, c in enumerate(columns) for x, s in c.items() if s is not None], "taxon string, site bigint, state string")
    profiles = {0: [0.1, 0.2, 0.3, 0.4], 100: [0.4, 0.3, 0.2, 0.1]}  # two blocks of draws
    models = [(dr, cat, r, pi) for dr, pi in profiles.items() for cat, r in enumerate((0.5, 2.0))]
    shared = spark.createDataFrame(models, "draw bigint, cat int, rate double, pi array<double>")
    weights = shared.select("draw", "cat", ((F.col("cat") + 1) / 3).alias("w"))
    reversible = shared.withColumn("rr", F.array(*[F.lit(x) for x in (1.0, 2.0, 0.5, 0.7, 3.0, 1.3)]))

    def solved():
        logl = [{(r.draw, r.site, r.cat): r.logl for r in lk.site_loglik(cells, small_tree, m, DNA).collect()} for m in (shared, reversible)]
        probs = [lk.ancestral_probs(cells, small_tree, m, DNA, w, raw_sum=w is None).collect() for m, w in ((shared, weights), (reversible, None))]
        return [*logl, *[{(r.node, r.site, r.state): r.prob for r in rows} for rows in probs]]

    monkeypatch.setattr(messages, "BLOCK_ROWS", 8)
    with monkeypatch.context() as m:
        m.setattr(messages, "leaf_messages", None)
        found = solved()
    monkeypatch.setattr(messages, "NODES_AT_ONCE", 1)
    for one, other in zip(found, solved(), strict=True):
        assert one and one == pytest.approx(other, abs=1e-9)
    # a table that is no tree with names for all nodes goes level by level too
    assert messages.Order.of(messages.tree_table(small_tree.unionByName(small_tree.filter("node = 'x'")))) is None


def test_order_of_a_long_tree(spark):
    """Children stand before their parent, the largest child first, so few nodes wait."""
    nodes = [("n0", None, None, None, 0)]
    for i in range(40):
        nodes += [(f"n{i + 1}", f"n{i}", None, 0.1, i + 1), (f"t{i}", f"n{i}", f"t{i}", 0.2, i + 1)]
    nodes += [("u0", "n40", "u0", 0.1, 41), ("u1", "n40", "u1", 0.3, 41)]
    order = messages.Order.of(messages.tree_table(spark.createDataFrame(nodes, "node string, parent string, taxon string, length double, depth int")))
    assert order.names == [f"n{i}" for i in range(40, -1, -1)]
    assert order.parent.tolist() == [*range(1, 41), -1]


def test_weights_meet_rows_of_sites_where_they_are(spark, capsys):
    """Few (draw, category) keys: a join by them would put all sites into a few tasks."""
    rows = [(dr, i, cat, -float(i + cat)) for dr in range(2) for i in range(8) for cat in range(2)]
    logl = spark.createDataFrame(rows, "draw bigint, site bigint, cat int, logl double")
    rates = spark.createDataFrame([(dr, cat, 1.0 + cat, 0.5) for dr in range(2) for cat in range(2)], "draw bigint, cat int, rate double, w double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables whose size Spark does not know
    try:
        for found in (lk.rate_mixture_loglik(logl, rates), lk.site_rate(logl, rates)):
            found.explain()
            assert "SortMergeJoin" not in capsys.readouterr().out
            assert found.count() == 16
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_selection_bins(spark):
    values = [-31.0, -30.0, -29.875, -29.874, 0.0, 0.125, 0.126, 29.9, 30.0, 31.0]

    def walk(s):
        if s < -30:
            return 0
        if s > 30:
            return 240
        c = 1
        while -30 + c * 0.25 + 0.125 < s:
            c += 1
        return c

    df = spark.createDataFrame([(v,) for v in values], "s double")
    assert [r[0] for r in df.select(ms.selection_bin(F.col("s"))).collect()] == [walk(v) for v in values]
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "s double").select(ms.fixation_factor(F.col("s"))).collect()]
    assert got == pytest.approx([1.0, 1 / (1 - math.exp(-1)), -1 / (1 - math.exp(1))])


def test_two_run_scores(spark):
    """Scores of two runs against the formulas written out."""
    rng = random.Random(9)
    data = [(r, s, rng.gauss(-5 - s, 1 + s / 4)) for r in ("one", "two") for s in range(6) for _ in range(30)]
    df = spark.createDataFrame(data, "run string, site int, logl double")
    got = {r.score_name: r for r in fit.loocv_waic(fit.site_scores(df)).collect()}

    def cpo(v):
        return min(v) - math.log(np.mean(np.exp(min(v) - np.array(v))))

    def post(v):
        return max(v) + math.log(np.mean(np.exp(np.array(v) - max(v))))

    per = {(r, s): [x for rr, ss, x in data if (rr, ss) == (r, s)] for r in ("one", "two") for s in range(6)}
    loo = [np.mean([cpo(per[r, s]) for s in range(6)]) for r in ("one", "two")]
    bias = 0.5 * np.mean([np.var([cpo(per[r, s]) for r in ("one", "two")], ddof=1) for s in range(6)])
    assert got["loocv"].score == pytest.approx(np.mean(loo) - bias)
    assert got["loocv"].ci_high == pytest.approx(np.mean(loo) - bias + 12.7062047362 * np.std(loo, ddof=1))
    waic = [np.mean([post(per[r, s]) - np.var(per[r, s]) for s in range(6)]) for r in ("one", "two")]
    wbias = -0.5 * np.mean([np.var([post(per[r, s]) for r in ("one", "two")], ddof=1) for s in range(6)])
    assert got["waic"].score == pytest.approx(np.mean(waic) - wbias)


def test_keyed_subsets(spark):
    from cladeframe.operators import fit, subsets

    rng = random.Random(8)
    sites = list(range(3, 40, 2))
    rows = [(run, i, s, rng.gauss(-3, 1)) for run in ("a", "b") for i in range(9) for s in sites if (i + s) % 7]
    logl = spark.createDataFrame(rows, "run string, iter bigint, site bigint, logl double")
    sizes = fit.curve_sizes(len(sites))
    sizes = [(k, min(reps, 40)) for k, reps in sizes]
    drawn = subsets.keyed_subsets(logl, sizes, 5)
    members = {}
    for r in drawn.collect():
        members.setdefault((r.k, r.rep), set()).add(r.site)
    assert {key: len(v) for key, v in members.items()} == {(k, rep): k for k, reps in sizes for rep in range(reps)}
    want = {(r.run, r.k): r for r in fit.cv_subset_curve(logl, drawn).collect()}
    got = {(r.run, r.k): r for r in subsets.subset_curve(logl, sizes, 5).collect()}
    assert got.keys() == want.keys()
    for key, row in got.items():
        assert tuple(row)[1:] == pytest.approx(tuple(want[key])[1:], rel=1e-9, abs=1e-9)
