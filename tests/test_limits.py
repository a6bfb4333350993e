"""Cases at the edge: any number of runs, impossible data, outliers, common prefixes, headers of their own."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import gamma, student
from cladeframe.functions import newick as nw
from cladeframe.functions.logspace import log_moments
from cladeframe.functions.ordered import order_statistics
from cladeframe.operators import alignment, fit, likelihood, posterior, trace
from cladeframe.operators import trees as tt
from cladeframe.sources import chains


def test_critical_values():
    assert student.critical_value(1) == pytest.approx(12.706204736432095)
    assert student.critical_value(10) == pytest.approx(2.2281388519649385)
    assert student.critical_value(1000) == pytest.approx(1.9623391, abs=1e-6)
    assert 1.959964 < student.critical_value(1001) < student.critical_value(1000)
    assert student.critical_value(200_000) == pytest.approx(student.critical_value(200_001), rel=1e-9)


@pytest.mark.parametrize("runs", [1, 2, 2000])
def test_scores_for_any_number_of_runs(spark, runs):
    scores = spark.range(runs * 2).select(
        F.concat(F.lit("r"), F.floor(F.col("id") / 2)).alias("run"), (F.col("id") % 2).alias("site"), (-F.rand(1)).alias("logcpo"),
        F.lit(20.0).alias("ess_cpo"), (-F.rand(2)).alias("logpostmeanl"), F.lit(20.0).alias("ess_l"), F.lit(0.1).alias("var"),
    )
    rows = fit.loocv_waic(scores).collect()
    assert [r.score_name for r in rows] == ["loocv", "waic"] and all(r.n_runs == runs for r in rows)
    assert all((r.ci_low is None) == (runs == 1) for r in rows)
    steps = scores.select("run", F.col("site").alias("cycle"), F.col("logcpo").alias("logz"), F.col("ess_l").alias("ess"))
    row = fit.marginal_likelihood(steps).first()
    assert row.n_runs == runs and (row.ci_low is None) == (runs == 1)


def test_impossible_sites(spark):
    """Different states at distance zero: the likelihood is zero in both forms and in mixtures."""
    trees = spark.createDataFrame([("r", 0, "((a:0,b:0):0.5,c:1);")], "run string, iter bigint, newick string")
    nodes = tt.tree_nodes(trees)
    cells = spark.createDataFrame([("a", 0, "A"), ("b", 0, "C"), ("c", 0, "A"), ("a", 1, "A"), ("b", 1, "A"), ("c", 1, "C")], "taxon string, site bigint, state string")
    models = spark.createDataFrame([(0, s, c, r, [0.4, 0.6]) for s in (0, 1, 2) for c, r in ((0, 1.0), (1, 2.0))], "draw bigint, site bigint, cat int, rate double, pi array<double>")
    found = {}
    for form in (likelihood.site_loglik, likelihood.site_loglik_levels):
        logl = form(cells, nodes, models, ["A", "C"])
        rows = {(r.site, r.cat): r.logl for r in logl.collect()}
        assert rows[0, 0] == rows[0, 1] == -math.inf and rows[2, 0] == 0.0 and math.isfinite(rows[1, 0])
        found[form] = logl
    values = [{(r.site, r.cat): r.logl for r in x.collect()} for x in found.values()]
    assert values[0][1, 1] == pytest.approx(values[1][1, 1])
    weights = spark.createDataFrame([(0, 0, 1.0, 0.5), (0, 1, 2.0, 0.5)], "draw bigint, cat int, rate double, w double")
    mixed = likelihood.mixture_site_loglik(found[likelihood.site_loglik], weights.select("draw", "cat", "w"))
    by_site = {r.site: r.logl for r in mixed.collect()}
    assert by_site[0] == -math.inf and math.isfinite(by_site[1])
    assert likelihood.total_loglik(mixed).first().total_logl == -math.inf
    rates = {r.site: r.site_rate for r in likelihood.site_rate(found[likelihood.site_loglik], weights).collect()}
    assert rates[0] is None and 1.0 < rates[1] < 2.0
    probs = likelihood.ancestral_probs(cells, nodes, models, ["A", "C"], weights).collect()
    assert {r.site for r in probs} == {1} and all(0 <= r.prob <= 1 for r in probs)


def test_log_moments_with_zero_likelihoods(spark):
    df = spark.createDataFrame([("k", -1.0), ("k", -math.inf), ("z", -math.inf)], "k string, x double")
    rows = {r.k: r.log_mean_exp for r in log_moments(df, ["k"], "x").collect()}
    assert rows["k"] == pytest.approx(math.log(math.exp(-1) / 2)) and rows["z"] == -math.inf


@pytest.mark.parametrize("alpha", [0.05, 1.0, 1e4, 1e6, 1e7, 1e9])
def test_gamma_rates_converge(alpha):
    rates = gamma.category_rates(np.array([alpha]), 4)[0]
    assert (np.diff(rates) > 0).all() and rates.mean() == pytest.approx(1.0, abs=1e-6)
    if alpha >= 1e6:  # the normal limit
        assert rates == pytest.approx(1 + np.array([-1.27106, -0.32465, 0.32465, 1.27106]) / math.sqrt(alpha), abs=2e-6)


def test_order_statistics_with_an_outlier(spark):
    df = spark.range(2000).select(F.lit("g").alias("k"), (F.col("id") / 7).alias("x")).unionByName(
        spark.createDataFrame([("g", 1e300), ("g", -1e300)], "k string, x double")
    )
    row = order_statistics(df, ["k"], "x", {"low": F.floor(F.col("n") * 0.1), "high": F.col("n") - 2}).first()
    values = sorted([i / 7 for i in range(2000)] + [1e300, -1e300])
    assert (row.n, row.low, row.high) == (2002, values[200], values[2000])


def test_taxa_with_a_common_beginning(spark):
    cells = spark.range(3000).select(F.format_string("Customer#%09d", "id").alias("taxon"))
    rows = alignment.taxon_index(cells).orderBy("taxon").collect()
    assert [r.taxon_ix for r in rows] == list(range(3000))


def test_reroot_keeps_trees_without_the_clade(spark):
    trees = spark.createDataFrame([("r", 0, "((a:1,b:1):1,(c:1,d:1):1);"), ("r", 1, "((a:1,c:1):1,(b:1,d:1):1);")], "run string, iter bigint, newick string")
    rows = {r.iter: (r.rooted, r.newick) for r in tt.reroot(trees, ["a", "b"]).collect()}
    assert rows[0][0] and not rows[1][0] and rows[1][1].endswith(";")


def test_traces_with_other_headers(spark, tmp_path):
    (tmp_path / "a.trace").write_text("#it\tt\ttopo\tx\ty\n0\t1\t1\t2\t3\n1\t1\t1\t4\t5\n")
    (tmp_path / "b.trace").write_text("#it\tt\ttopo\ty\n0\t1\t1\t7\n")
    rows = {(r.run, r.iter, r.param): r.value for r in chains.read_traces(spark, str(tmp_path)).collect()}
    assert rows == {("a", 0, "x"): 2.0, ("a", 0, "y"): 3.0, ("a", 1, "x"): 4.0, ("a", 1, "y"): 5.0, ("b", 0, "y"): 7.0}


def test_burn_in_below_minus_one(spark):
    with pytest.raises(ValueError, match="burn-in"):
        trace.align_traces(spark.createDataFrame([("r", 0, "p", 1.0)], "run string, iter bigint, param string, value double"), -2)


def test_reroot_of_a_wide_tree():
    n = 40_000
    wide = nw.parse("(" + ",".join(f"(x{i}:1,y{i}:1):1" for i in range(n // 2)) + ",o:2);")
    start = time.perf_counter()
    root, rooted = nw.reroot(wide, {"o"})
    assert time.perf_counter() - start < 5  # in steps of one set per node this took a minute
    assert rooted and [c.taxon for c in root.children] == ["o", None] and len(root.children[1].children) == n // 2


def test_reroot_finds_the_branch_of_the_sets():
    import random

    rnd = random.Random(7)
    for _ in range(300):
        parts = [f"{rnd.choice('abcdefgh')}:{rnd.randint(1, 9)}" if rnd.random() < 0.95 else "" for _ in range(rnd.randint(2, 8))]
        while len(parts) > 3:
            k = rnd.randint(1, 3)
            rnd.shuffle(parts)
            parts = [f"({','.join(parts[:k])}):{rnd.randint(1, 9)}", *parts[k:]]
        group = set(rnd.sample("abcdefgh", rnd.randint(1, 3)))
        text = f"({','.join(parts)});"
        tree = nw.unroot(nw.parse(text))
        sets, listed = nw.leaf_sets(tree), [n for n, _, _ in tree.walk()]
        everyone = sets[id(tree)]
        target = group & everyone
        spot = None
        if target and target != everyone:
            spot = next((n for n in listed[1:] if sets[id(n)] in (target, everyone - target)), None)
        root, rooted = nw.reroot(nw.parse(text), group)
        assert rooted == (spot is not None)
        if spot is None:
            assert nw.render(root) == nw.render(tree)
        else:
            first = nw.leaf_sets(root)[id(root.children[0])]
            assert len(root.children) == 2 and first == sets[id(spot)]


def test_order_statistics_seek_the_bucket_by_halves(spark):
    values = {"ties": [float(i % 5) for i in range(700)], "few": [3.0, -1.0], "one": [2.5], "many": [((i * 7919) % 4001) / 8 for i in range(4001)]}
    df = spark.createDataFrame([(k, x) for k, v in values.items() for x in v] + [("few", None)], "k string, x double")
    ranks = {"low": F.floor(F.col("n") * 0.05), "mid": F.floor(F.col("n") / 2), "high": F.col("n") - 1}
    found = order_statistics(df, ["k"], "x", ranks)
    for r in found.collect():
        v = sorted(values[r.k])
        assert (r.n, r.low, r.mid, r.high) == (len(v), v[int(len(v) * 0.05)], v[len(v) // 2], v[-1])
    # one look at all cuts per row took 8 microseconds, and a key's rows may lie in one task
    assert "filter(_cuts" not in found._jdf.queryExecution().toString()


def profiles_by_hand(alloc, profiles):
    n, sums = {}, {}
    for run, it, site, comp in alloc:
        if site is not None:
            n[site] = n.get(site, 0) + 1
            for r, i, c, state, freq in profiles:
                if comp is not None and (r, i, c) == (run, it, comp):
                    old = sums.get((site, state))
                    sums[site, state] = old if freq is None else freq + (old or 0.0)
    return {k: None if v is None else pytest.approx(v / n[k[0]]) for k, v in sums.items()}


@pytest.mark.parametrize("n_states", [3, 62, 63])
def test_site_profiles_sum_one_row_per_site(spark, n_states):
    alloc = [("r", i, s if s < 9 else None, (s + i) % 4 if s != 3 or i else None) for i in range(3) for s in range(10)]
    alloc += [alloc[0], ("r", 9, 2, 0), ("q", 0, 11, 7)]
    profiles = [("r", i, c, f"s{k}", (k + c + i) / 10) for i in range(3) for c in range(3) for k in range(n_states - 1) if k != c]
    profiles += [profiles[0], ("r", 1, 1, None, 0.5), ("r", 2, 0, None, None), ("r", 0, None, "s0", 1.0)]
    made = posterior.mean_site_profiles(
        spark.createDataFrame(alloc, "run string, iter int, site int, comp int"),
        spark.createDataFrame(profiles, "run string, iter int, comp int, state string, freq double"),
    )
    got = [((r.site, r.state), r.freq) for r in made.collect()]
    assert len(got) == len(dict(got)) and dict(got) == profiles_by_hand(alloc, profiles)
    groups = [x for x in made._jdf.queryExecution().toString().splitlines() if "Aggregate(keys=[site#" in x]
    assert groups and (n_states > posterior.STATES_AT_ONCE or not any("state#" in x.split("functions=")[0] for x in groups))
