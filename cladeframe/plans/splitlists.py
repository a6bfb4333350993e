"""Split-list queries: frequencies, run comparison, conflicts and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe import tables as t
from cladeframe.functions import splits as fs
from cladeframe.operators import splits as sp
from cladeframe.operators import trees as tt
from cladeframe.plans.views_sql import cte, mask_text, rnd, tidy

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def show(df, digits: int = 6, **special):
    """Splits as text."""
    for c in ("split", "split_b"):
        if c in df.columns:
            df = df.withColumn(c, F.array_join(c, "|"))
    return tidy(df, digits, **special)


def freq(spark, d):
    return sp.split_freq(t.splits_ord(spark, d), t.order_trees(spark, d))


def merged(spark, d):
    return sp.merge_runs(freq(spark, d), t.order_trees(spark, d))


M = mask_text("m")
_SIDE = "CASE WHEN run = 'F' THEN 'F' ELSE 'rest' END"
_SIDES = (
    f", o AS (SELECT {_SIDE} AS g, m, length FROM splits_ord), k AS (SELECT {_SIDE} AS g, count(*) AS n_trees FROM order_mask GROUP BY 1), "
    "c AS (SELECT g, m, count(*) / any_value(n_trees)::DOUBLE AS prob, avg(length) AS mean_length FROM o JOIN k USING (g) GROUP BY 1, 2), "
)


def by_side(spark, d):
    """Trees and splits with run F on one side and all other runs together on the other."""
    side = F.when(F.col("run") == "F", "F").otherwise("rest")
    trees = t.order_trees(spark, d).groupBy(side.alias("run")).agg(F.sum("n_trees").alias("n_trees"))
    return trees, t.splits_ord(spark, d).withColumn("run", side)


@register("canonical_split", cte("splits_ord", f"SELECT run, iter, {M} AS split, {rnd('length', 'length')} FROM splits_ord"))
def _(spark, d):
    return show(t.splits_ord(spark, d))


@register("split_freq", cte("split_freq", f"SELECT run, {M} AS split, n, {rnd('prob', 'prob')}, {rnd('mean_length', 'mean_length')} FROM split_freq"))
def _(spark, d):
    return show(freq(spark, d))


@register("merge_runs", cte("merged", f"SELECT {M} AS split, n, {rnd('prob', 'prob')}, {rnd('mean_length', 'mean_length')} FROM merged"))
def _(spark, d):
    return show(merged(spark, d))


@register("split_matrix", cte(
    "split_freq",
    f"SELECT {M} AS split, r.run, {rnd('coalesce(f.prob, 0)', 'prob')}, {rnd('coalesce(f.mean_length, 0)', 'mean_length')} "
    "FROM (SELECT DISTINCT m FROM split_freq) CROSS JOIN (SELECT DISTINCT run FROM split_freq) r LEFT JOIN split_freq f USING (m, run)",
))
def _(spark, d):
    return show(sp.split_matrix(freq(spark, d)))


_CMP = (
    ", full_m AS (SELECT m, r.run, coalesce(f.prob, 0) AS prob FROM (SELECT DISTINCT m FROM split_freq) CROSS JOIN (SELECT DISTINCT run FROM split_freq) r LEFT JOIN split_freq f USING (m, run)), "
    "pd AS (SELECT a.m, max(abs(a.prob - b.prob)) AS maxdiff, avg(abs(a.prob - b.prob)) AS mean_diff FROM full_m a JOIN full_m b ON a.m = b.m AND a.run < b.run GROUP BY 1), "
    "cmp AS (SELECT m, maxdiff, mean_diff, mean_prob, n_present FROM pd JOIN (SELECT m, avg(prob) AS mean_prob, count(*) FILTER (prob > 0) AS n_present FROM full_m GROUP BY 1) USING (m)) "
)


@register("compare_runs_splits", cte(
    "split_freq", _CMP + f"SELECT {M} AS split, {rnd('maxdiff', 'maxdiff')}, {rnd('mean_diff', 'mean_diff')}, {rnd('mean_prob', 'mean_prob')}, n_present FROM cmp"
))
def _(spark, d):
    return show(sp.compare_runs_splits(freq(spark, d)))


@register("overall_difference", cte(
    "split_freq", _CMP + f"SELECT count(*) AS n_splits, {rnd('max(maxdiff)', 'maxdiff', 8)}, {rnd('sum(mean_prob * mean_diff) / sum(mean_prob)', 'meandiff', 8)} FROM cmp"
))
def _(spark, d):
    return show(sp.overall_difference(sp.compare_runs_splits(freq(spark, d))), 8)


# the last run (status P) serves as the reference list
_REF = ", f AS (SELECT * FROM split_freq WHERE run <> 'P'), ref AS (SELECT m, prob AS refprob, mean_length AS reflength FROM split_freq WHERE run = 'P') "


def versus(spark, d):
    both = freq(spark, d)
    return both.filter(F.col("run") != "P"), both.filter(F.col("run") == "P").drop("run")


@register("split_vs_reference", cte(
    "split_freq",
    _REF + f"SELECT run, {M} AS split, n, {rnd('prob', 'prob')}, {rnd('mean_length', 'mean_length')}, {rnd('coalesce(refprob, 0)', 'refprob')}, {rnd('coalesce(reflength, 0)', 'reflength')} FROM f LEFT JOIN ref USING (m)",
))
def _(spark, d):
    return show(sp.split_vs_reference(*versus(spark, d)))


@register("compare_to_reference", cte(
    "split_freq",
    _REF + _CMP.replace("split_freq", "f") + ", x AS (SELECT m, coalesce(maxdiff, 0) AS maxdiff, coalesce(mean_diff, 0) AS mean_diff, coalesce(mean_prob, 0) AS mean_prob, "
    "coalesce(n_present, 0) AS n_present, coalesce(refprob, 0) AS refprob, coalesce(reflength, 0) AS reflength FROM cmp FULL JOIN ref USING (m)) "
    f"SELECT {M} AS split, {rnd('maxdiff', 'maxdiff')}, {rnd('mean_diff', 'mean_diff')}, {rnd('mean_prob', 'mean_prob')}, n_present, {rnd('refprob', 'refprob')}, {rnd('reflength', 'reflength')}, "
    f"{rnd('abs(refprob - mean_prob)', 'refdiff')} FROM x WHERE abs(refprob - mean_prob) > 0.001",
))
def _(spark, d):
    mine, ref = versus(spark, d)
    return show(sp.compare_to_reference(mine, ref, 0.001).fillna(0, ["n_present"]))


@register("informative_splits", cte("splits_ord", f"SELECT run, {M} AS split, count(*) AS n FROM splits_ord WHERE bit_count(m) BETWEEN 2 AND 6 GROUP BY 1, 2"))
def _(spark, d):
    kept = sp.informative_splits(t.splits_ord(spark, d), 8)
    return show(kept.groupBy("run", "split").agg(F.count(F.lit(1)).alias("n")))


@register("truncate_splits", cte("split_freq", f"SELECT run, {M} AS split, {rnd('prob', 'prob')} FROM split_freq WHERE prob >= 0.0101234"))
def _(spark, d):
    return show(sp.truncate_splits(freq(spark, d), 0.0101234).select("run", "split", "prob"))


@register("top_splits", cte("merged", f"SELECT {M} AS split, n, row_number() OVER (ORDER BY n DESC, {M}) AS rank FROM merged WHERE prob >= 0.002 ORDER BY n DESC, {M} LIMIT 20"))
def _(spark, d):
    """The twenty most frequent splits."""
    return show(sp.top_splits(merged(spark, d), 0.002, 20).select("split", "n", "rank"))


@register("rank_splits", cte("split_freq", _CMP + f"SELECT {M} AS split, {rnd('maxdiff', 'maxdiff')}, row_number() OVER (ORDER BY maxdiff DESC, {M}) AS rank FROM cmp"))
def _(spark, d):
    """Splits by falling difference between runs."""
    return show(sp.rank_splits(sp.compare_runs_splits(freq(spark, d)), "maxdiff").select("split", "maxdiff", "rank"))


@register("split_histogram", cte("split_freq", "SELECT least(floor(prob * 2000), 1999)::BIGINT AS bin, count(*) AS n FROM split_freq GROUP BY 1"))
def _(spark, d):
    return show(sp.split_histogram(freq(spark, d), 2000))


@register("splits_equal", cte(
    "splits_ord",
    _SIDES + "a AS (SELECT * FROM c WHERE g = 'F'), b AS (SELECT * FROM c WHERE g = 'rest') "
    "SELECT count(*) FILTER (NOT coalesce(abs(a.prob - b.prob) <= 1e-6 AND abs(a.mean_length - b.mean_length) <= 1e-6, false)) AS n_different, "
    "count(*) FILTER (NOT coalesce(abs(a.prob - b.prob) <= 1e-6 AND abs(a.mean_length - b.mean_length) <= 1e-6, false)) = 0 AS equal FROM a FULL JOIN b USING (m)",
))
def _(spark, d):
    trees, splits = by_side(spark, d)
    both = sp.split_freq(splits, trees)
    return show(sp.splits_equal(both.filter(F.col("run") == "F"), both.filter(F.col("run") == "rest")))


@register("check_split_duplicates", cte(
    "order_mask",
    ", x AS (SELECT DISTINCT run, raw FROM order_mask), c AS (SELECT run, CASE WHEN raw & 1 = 1 THEN 255 - raw ELSE raw END AS m FROM x) "
    f"SELECT run, {M} AS split, count(*) AS copies FROM c GROUP BY 1, m HAVING count(*) > 1",
))
def _(spark, d):
    """Raw supplier sets that are equal or complementary within a run."""
    mask = F.collect_set((F.col("l_suppkey") % 8).cast("string"))
    orders = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("run"))
    raw = t.lineitem(spark, d).groupBy("l_orderkey").agg(F.array_sort(mask).alias("split")).join(orders, "l_orderkey")
    return show(sp.check_split_duplicates(raw.select("run", "split").distinct(), t.taxa_ord()))


_CUT = "(CASE WHEN m & 2 = 2 THEN 62 - (m & 62) ELSE m & 62 END)"


@register("restrict_splits", cte(
    "splits_ord",
    f", c AS (SELECT run, iter, {_CUT} AS m, length FROM splits_ord) SELECT run, {M} AS split, count(*) AS n, {rnd('sum(length)', 'total', 5)} FROM c WHERE m <> 0 GROUP BY 1, m",
))
def _(spark, d):
    """Splits without the taxa 0, 6 and 7."""
    kept = F.array(*[F.lit(x) for x in "12345"])
    cut = sp.restrict_splits(t.splits_ord(spark, d), kept)
    return show(cut.groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")), 5)


@register("split_set_operations", cte(
    "splits_ord",
    f"SELECT run, {mask_text('m | 6')} AS with_12, {mask_text('m & 60')} AS inner_part, {mask_text('255 - m')} AS other_side, count(*) AS n FROM splits_ord GROUP BY run, m",
))
def _(spark, d):
    s = F.col("split")
    two, inner = F.array(F.lit("1"), F.lit("2")), F.array(*[F.lit(x) for x in "2345"])
    counts = t.splits_ord(spark, d).groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"))
    return tidy(counts.select(
        "run", F.array_join(fs.split_or(s, two), "|").alias("with_12"), F.array_join(fs.split_and(s, inner), "|").alias("inner_part"),
        F.array_join(fs.split_not(s, t.taxa_ord()), "|").alias("other_side"), "n",
    ))


_MARKS = "concat(" + ", ".join(f"CASE WHEN m & {1 << i} <> 0 THEN '*' ELSE '.' END" for i in range(8)) + ")"


@register("split_text", cte(
    "splits_ord",
    ", x AS (SELECT run, m, count(*) AS n FROM splits_ord GROUP BY 1, 2) "
    f"SELECT run, {_MARKS} AS text, {M} AS again, {mask_text('CASE WHEN bit_count(m) > 4 THEN 255 - m ELSE m END')} AS smaller, n FROM x",
))
def _(spark, d):
    """Splits as dots and stars, read back, and as the list of the smaller side."""
    counts = t.splits_ord(spark, d).groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"))
    text = fs.split_to_string(F.col("split"), t.taxa_ord())
    return tidy(counts.select("run", text.alias("text"), "split", "n").select(
        "run", "text", F.array_join(fs.split_from_string(F.col("text"), t.taxa_ord()), "|").alias("again"),
        F.array_join(fs.smaller_side(F.col("split"), t.taxa_ord()), "|").alias("smaller"), "n",
    ))


# odd products 1 * 3 * ... * (2 a - 3) for a = 1..7
_DF = "(CASE {0} WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 15 WHEN 5 THEN 105 WHEN 6 THEN 945 ELSE 10395 END)"


@register("split_prior", cte(
    "merged",
    f", z AS (SELECT m, n, bit_count(m)::BIGINT AS a FROM merged) SELECT {M} AS split, n, "
    f"{rnd(_DF.format('a') + ' * ' + _DF.format('(8 - a)') + ' / 10395.0', 'prior', 8)} FROM z",
))
def _(spark, d):
    """Observed splits with their prior probability on random trees."""
    prior = fs.split_prior(F.size("split"), F.lit(8))
    return show(merged(spark, d).select("split", "n", prior.alias("prior")), 8)


_CONFLICT = "({0} & {1}) <> 0 AND ({0} & {1}) <> {0} AND ({0} & {1}) <> {1}"


@register("split_conflicts", cte(
    "merged",
    f"SELECT {mask_text('a.m')} AS split, {mask_text('b.m')} AS split_b, {rnd('b.prob', 'prob_b')} FROM merged a JOIN merged b ON b.prob >= 0.01 AND {_CONFLICT.format('a.m', 'b.m')}",
))
def _(spark, d):
    """Conflicts of every split with the splits of at least one per cent."""
    everything = merged(spark, d)
    found = sp.split_conflicts(everything, sp.truncate_splits(everything, 0.01))
    return show(found.select("split", "split_b", "prob_b"))


@register("compatible_with", cte(
    "merged", f"SELECT {mask_text('a.m')} AS split, a.n FROM merged a WHERE NOT EXISTS (SELECT 1 FROM merged b WHERE b.prob >= 0.01 AND {_CONFLICT.format('a.m', 'b.m')})"
))
def _(spark, d):
    everything = merged(spark, d)
    return show(sp.compatible_with(everything, sp.truncate_splits(everything, 0.01)).select("split", "n"))


_SH = "(CASE WHEN m & 2 = 2 THEN 126 - (m & 126) ELSE m & 126 END)"
_SHARED = (
    f", o AS (SELECT DISTINCT {_SIDE} AS g, run, iter, {_SH} AS m FROM splits_ord), "
    f"k AS (SELECT {_SIDE} AS g, count(*) AS n_trees FROM order_mask GROUP BY 1), "
    "c AS (SELECT g, m, count(*) / any_value(n_trees)::DOUBLE AS prob FROM o JOIN k USING (g) WHERE m <> 0 GROUP BY 1, 2), "
    "a AS (SELECT m, prob FROM c WHERE g = 'F'), b AS (SELECT m, prob FROM c WHERE g = 'rest') "
)


def _restricted(spark, d):
    """Split frequencies of run F and of all other runs together, on the taxa 1 to 6."""
    trees, splits = by_side(spark, d)
    both = sp.restricted_freq(splits, trees, F.array(*[F.lit(x) for x in "123456"]))
    return both.filter(F.col("run") == "F"), both.filter(F.col("run") == "rest")


@register("split_support", cte("splits_ord", _SHARED + f"SELECT {M} AS split, {rnd('a.prob', 'prob')}, {rnd('coalesce(b.prob, 0)', 'support')} FROM a LEFT JOIN b USING (m)"))
def _(spark, d):
    """Support of one run's splits in the others, on the taxa 1 to 6."""
    return show(sp.split_support(*_restricted(spark, d)))


@register("split_compat_with", cte(
    "splits_ord",
    _SHARED + f"SELECT {mask_text('a.m')} AS split, {rnd('any_value(a.prob)', 'prob')}, count(b.m) AS n_conflicts, {rnd('coalesce(max(b.prob), 0)', 'max_conflict')} FROM a LEFT JOIN b ON {_CONFLICT.format('a.m', 'b.m')} GROUP BY a.m",
))
def _(spark, d):
    return show(sp.split_compat_with(*_restricted(spark, d)))


def _greedy_cte(cutoff: float) -> str:
    """The greedy rule as a recursion over the ranked splits; ``g`` lists what is kept after each."""
    clash = _CONFLICT.format("r.m", "k.x")
    return cte("merged", "SELECT 1").replace("WITH ", "WITH RECURSIVE ", 1).removesuffix("\nSELECT 1") + (
        f", r AS (SELECT m, n, prob, row_number() OVER (ORDER BY n DESC, {M}) AS i FROM merged WHERE prob >= {cutoff}), "
        "g(i, kept) AS (SELECT 0::BIGINT, []::INT[] UNION ALL SELECT g.i + 1, CASE WHEN "
        f"(SELECT count(*) FROM (SELECT unnest(g.kept) AS x) k WHERE {clash}) = 0 THEN list_append(g.kept, r.m::INT) ELSE g.kept END FROM g JOIN r ON r.i = g.i + 1), "
        "final AS (SELECT m::INT AS m, n, prob, mean_length FROM merged WHERE list_contains((SELECT arg_max(kept, i) FROM g), m::INT)) "
    )


def _greedy_sql(cutoff: float) -> str:
    return _greedy_cte(cutoff) + f"SELECT {M} AS split, n, {rnd('prob', 'prob')} FROM final"


def _tree_sql(cutoff: float) -> str:
    """The kept splits as nested text: clades by size, each takes the finished parts inside it."""
    inside = "list_filter(b.parts, lambda e: (e.m & c.m) <> 0)"
    return _greedy_cte(cutoff) + (
        ", leaf AS (SELECT t::VARCHAR AS f, t::VARCHAR || coalesce(printf(':%.6f', CASE WHEN t = 0 THEN (SELECT max(mean_length) FROM final WHERE bit_count(m) = 7) "
        "ELSE (SELECT max(mean_length) FROM final WHERE m = (1 << t)) END), '') AS x, (1 << t)::INT AS m FROM (SELECT unnest(range(8))::INT AS t)), "
        "c AS (SELECT m, prob, mean_length, row_number() OVER (ORDER BY bit_count(m), m) AS i FROM final WHERE bit_count(m) BETWEEN 2 AND 6), "
        "b(i, parts) AS (SELECT 0::BIGINT, list({'f': f, 'x': x, 'm': m}) FROM leaf UNION ALL SELECT b.i + 1, "
        "list_append(list_filter(b.parts, lambda e: (e.m & c.m) = 0), {"
        f"'f': list_min(list_transform({inside}, lambda e: e.f)), "
        f"'x': '(' || array_to_string(list_transform(list_sort({inside}), lambda e: e.x), ',') || ')' || printf('%.2f', c.prob) || printf(':%.6f', c.mean_length), "
        "'m': c.m}) FROM b JOIN c ON c.i = b.i + 1) "
        "SELECT 'consensus' AS tree_id, '(' || array_to_string(list_transform(list_sort(arg_max(parts, i)), lambda e: e.x), ',') || ');' AS newick FROM b"
    )


@register("consensus_splits", _greedy_sql(0.005))
def _(spark, d):
    """Greedy consensus of all orders."""
    return show(sp.consensus_splits(merged(spark, d), 0.005).select("split", "n", "prob"))


@register("consensus_tree", _tree_sql(0.005))
def _(spark, d):
    """Newick text of the greedy consensus tree."""
    taxa = spark.createDataFrame([(x,) for x in t.ORDER_TAXA], "taxon string")
    nodes = tt.with_depth(sp.consensus_nodes(sp.consensus_splits(merged(spark, d), 0.005), taxa))
    return tt.to_newick(nodes.withColumn("tree_id", F.lit("consensus")), ["tree_id"])
