"""Tree queries: one tree per order, and the supplier tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe import tables as t
from cladeframe.operators import clades as cl
from cladeframe.operators import splits as sp
from cladeframe.operators import trace as tr
from cladeframe.operators import trees as tt
from cladeframe.plans.views_sql import cte, rnd, tidy

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


_RUN = "JOIN (SELECT o_orderkey AS l_orderkey, o_orderstatus AS run FROM orders) USING (l_orderkey)"
_LEN = "(SELECT l_orderkey, sum(len) AS leaf_len FROM order_leaves GROUP BY 1) USING (l_orderkey)"


@register("tree_nodes", cte(
    "order_clades",
    f", x AS (SELECT l_orderkey, 0 AS depth, 1 AS n, 0.0 AS len FROM order_clades GROUP BY 1 UNION ALL SELECT l_orderkey, 1, count(*), 0.0 FROM order_clades GROUP BY 1 "
    "UNION ALL SELECT l_orderkey, 2, sum(size), 0.0 FROM order_clades WHERE size > 1 GROUP BY 1) "
    f"SELECT run, depth::BIGINT AS depth, sum(n)::BIGINT AS n FROM x {_RUN} GROUP BY 1, 2",
))
def _(spark, d):
    """Nodes of all order trees by depth."""
    return tidy(tt.tree_nodes(t.newick_ord(spark, d)).groupBy("run", "depth").agg(F.count(F.lit(1)).alias("n")))


_STATS = (
    "SELECT l_orderkey, sum(size)::BIGINT AS n_leaves, (1 + sum(size) + count(*) FILTER (size > 1))::BIGINT AS n_nodes, "
    "sum(CASE WHEN size > 1 THEN size / 10.0 ELSE 0 END) AS clade_len, max(CASE WHEN size > 1 THEN 2 ELSE 1 END)::BIGINT AS height, count(*) AS n_clades FROM order_clades GROUP BY 1"
)


@register("tree_stats", cte("order_clades", f"SELECT run, l_orderkey AS iter, n_leaves, n_nodes, {rnd('leaf_len + clade_len', 'length')}, height FROM ({_STATS}) JOIN {_LEN} {_RUN}"))
def _(spark, d):
    return tidy(tt.tree_stats(tt.tree_nodes(t.newick_ord(spark, d)), ["run", "iter"]))


_LOWEST = "(total & -total)"
_MASKS = (
    ", lv AS (SELECT l_orderkey, flag, (1 << t::INT) AS m, len FROM order_leaves), tot AS (SELECT l_orderkey, sum(m)::BIGINT AS total FROM lv GROUP BY 1), "
    "sides AS (SELECT l_orderkey, m::BIGINT AS m, len FROM lv UNION ALL SELECT l_orderkey, sum(m)::BIGINT, count(*) / 10.0 FROM lv GROUP BY l_orderkey, flag HAVING count(*) > 1), "
    f"sp AS (SELECT l_orderkey, CASE WHEN m & {_LOWEST} <> 0 THEN total - m ELSE m END AS m, len, m = total AS whole FROM sides JOIN tot USING (l_orderkey)), "
    "one AS (SELECT l_orderkey, m, sum(len) AS len FROM sp WHERE NOT whole GROUP BY 1, 2) "
)


def _names(m: str = "m") -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {m} & {1 << i} <> 0 THEN 't{i}' END" for i in range(8)) + ")"


@register("tree_splits", cte("order_leaves", _MASKS + f"SELECT run, {_names()} AS split, count(*) AS n, {rnd('avg(len)', 'mean_length')} FROM one {_RUN} GROUP BY run, m"))
def _(spark, d):
    """Split counts and mean lengths over the unrooted order trees."""
    found = cl.split_counts(t.newick_ord(spark, d)).drop("n_supported", "mean_support")
    return tidy(found.withColumn("split", F.array_join("split", "|")))


@register("tree_split_supports", cte(
    "order_leaves",
    _MASKS + ", cs AS (SELECT l_orderkey, flag, sum(m)::BIGINT AS c, count(*) / 10.0 AS support FROM lv GROUP BY 1, 2 HAVING count(*) > 1), "
    f"cm AS (SELECT l_orderkey, CASE WHEN c & {_LOWEST} <> 0 THEN total - c ELSE c END AS m, flag, support FROM cs JOIN tot USING (l_orderkey) WHERE c <> total), "
    "w AS (SELECT l_orderkey, m, arg_min(support, flag) AS weight FROM cm GROUP BY 1, 2) "
    f"SELECT run, {_names()} AS split, count(*) AS n, count(weight) AS n_supported, {rnd('avg(weight)', 'mean_support')} FROM one LEFT JOIN w USING (l_orderkey, m) {_RUN} GROUP BY run, m",
))
def _(spark, d):
    """Supports of the splits of the order trees, a tenth of a clade's leaf number written behind it."""
    marked = t.newick_ord(spark, d).withColumn("newick", F.regexp_replace("newick", r"\):([0-9.]+)", r")$1:$1"))
    found = cl.split_counts(marked).drop("mean_length")
    return tidy(found.withColumn("split", F.array_join("split", "|")))


@register("tree_splits_rooted", cte(
    "order_clades",
    f", x AS (SELECT l_orderkey, array_to_string(members, '|') AS split FROM order_clades WHERE size > 1 UNION ALL SELECT l_orderkey, 't' || t FROM order_leaves), "
    "nl AS (SELECT l_orderkey, count(*) AS k FROM order_leaves GROUP BY 1) "
    f"SELECT run, split, count(*) AS n FROM x JOIN nl USING (l_orderkey) {_RUN} WHERE len(string_split(split, '|')) < k GROUP BY 1, 2",
))
def _(spark, d):
    found = cl.split_counts(t.newick_ord(spark, d), rooted=True).select("run", "split", "n")
    return tidy(found.withColumn("split", F.array_join("split", "|")))


@register("unroot", cte(
    "order_clades",
    f", s AS ({_STATS}) SELECT run, l_orderkey AS iter, n_leaves, {rnd('leaf_len + CASE WHEN n_clades > 1 THEN clade_len ELSE 0 END', 'length')} FROM s JOIN {_LEN} {_RUN}",
))
def _(spark, d):
    """Unrooted order trees keep leaves and total length."""
    return tidy(tt.tree_stats(tt.tree_nodes(tt.unroot(t.newick_ord(spark, d))), ["run", "iter"]).select("run", "iter", "n_leaves", "length"))


@register("reroot", cte(
    "order_clades",
    f", s AS ({_STATS}) SELECT run, l_orderkey AS iter, n_leaves, {rnd('leaf_len + CASE WHEN n_clades > 1 THEN clade_len ELSE 0 END', 'length')} FROM s JOIN {_LEN} {_RUN}",
))
def _(spark, d):
    """Order trees rooted at taxon t0: leaves and total length stay."""
    return tidy(tt.tree_stats(tt.tree_nodes(tt.reroot(t.newick_ord(spark, d), ["t0"])), ["run", "iter"]).select("run", "iter", "n_leaves", "length"))


@register("root_split_freq", cte(
    "order_clades",
    f", f AS (SELECT l_orderkey, array_to_string(arg_min(members, flag), '|') AS split FROM order_clades GROUP BY 1), r AS (SELECT * FROM f {_RUN}), "
    "p AS (SELECT run, split, count(*) AS n, count(*) / any_value(k)::DOUBLE AS prob FROM r JOIN (SELECT run, count(*) AS k FROM r GROUP BY 1) USING (run) GROUP BY 1, 2) "
    f"SELECT run, split, n, {rnd('prob', 'prob')}, {rnd('sum(prob) OVER (PARTITION BY split) / (SELECT count(DISTINCT run) FROM p)', 'mean_prob')} FROM p",
))
def _(spark, d):
    return tidy(cl.root_split_freq(t.newick_ord(spark, d)).withColumn("split", F.array_join("split", "|")))


@register("prune_taxa", cte(
    "order_leaves",
    ", c AS (SELECT l_orderkey, flag, count(*) AS size, count(*) FILTER (t <= 4) AS kept, sum(CASE WHEN t <= 4 THEN len ELSE 0 END) AS len FROM order_leaves GROUP BY 1, 2), "
    "o AS (SELECT l_orderkey, count(*) FILTER (kept > 0) AS groups, sum(kept)::BIGINT AS n_leaves, "
    "sum(CASE WHEN kept = 0 THEN 0 ELSE len + CASE WHEN size > 1 THEN size / 10.0 ELSE 0 END END) AS all_len, "
    "sum(CASE WHEN kept > 0 THEN len END) AS leaf_len, count(*) FILTER (kept > 1) AS inner_nodes FROM c GROUP BY 1) "
    "SELECT run, l_orderkey AS iter, n_leaves, (CASE WHEN groups > 1 THEN 1 + n_leaves + inner_nodes WHEN n_leaves > 1 THEN 1 + n_leaves ELSE 1 END)::BIGINT AS n_nodes, "
    f"{rnd('CASE WHEN groups > 1 THEN all_len WHEN n_leaves > 1 THEN leaf_len ELSE 0 END', 'length')} FROM o {_RUN} WHERE n_leaves > 0",
))
def _(spark, d):
    """Order trees reduced to the taxa t0 to t4."""
    kept = tt.prune_taxa(t.newick_ord(spark, d), [f"t{i}" for i in range(5)])
    return tidy(tt.tree_stats(tt.tree_nodes(kept), ["run", "iter"]).drop("height"))


@register("thin_trees", cte(
    "trace_wide",
    ", n AS (SELECT run, max(iter) + 1 AS n FROM trace_wide GROUP BY 1) SELECT run, iter FROM trace_wide JOIN n USING (run) WHERE iter >= n // 5 AND (iter - n // 5) % 10 = 0",
))
def _(spark, d):
    """Default burn-in (a fifth) and every tenth record of each run."""
    points = t.event_trace(spark, d).filter(F.col("param") == "k").select("run", "iter")
    return tidy(tr.thin_trees(points, -1, 10))


@register("thin_tree_list", cte(
    "order_mask",
    ", n AS (SELECT run, max(iter) + 1 AS n FROM order_mask GROUP BY 1) SELECT run, iter, bit_count(raw)::BIGINT AS n_leaves FROM order_mask JOIN n USING (run) WHERE iter >= n // 5 AND (iter - n // 5) % 10 = 0",
))
def _(spark, d):
    """The same on the order trees themselves, with the leaves of the trees that stay."""
    kept = tr.thin_trees(t.newick_ord(spark, d), -1, 10)
    return tidy(tt.tree_stats(tt.tree_nodes(kept), ["run", "iter"]).select("run", "iter", "n_leaves"))


@register("complete_trees", cte(
    "order_leaves",
    f", k AS (SELECT l_orderkey FROM order_leaves WHERE t <= 2 GROUP BY 1 HAVING count(*) = 3) SELECT run, l_orderkey AS iter FROM k {_RUN}",
))
def _(spark, d):
    """Order trees cut down to t0, t1 and t2 that have all three."""
    names = ["t0", "t1", "t2"]
    return tidy(cl.complete_trees(tt.prune_taxa(t.newick_ord(spark, d), names), names).select("run", "iter"))


@register("compatible_runs", (
    "WITH x AS (SELECT DISTINCT o_orderpriority AS run, o_custkey AS taxon FROM orders), b AS (SELECT taxon FROM x WHERE run = (SELECT min(run) FROM x)) "
    "SELECT run, count(*) AS n_taxa, count(b.taxon) AS n_common, count(*) = count(b.taxon) AND count(*) = (SELECT count(*) FROM b) AS compatible FROM x LEFT JOIN b USING (taxon) GROUP BY 1"
))
def _(spark, d):
    """Customers per order priority compared with the first priority."""
    return tidy(sp.compatible_runs(t.load(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_custkey").alias("taxon"))))


@register("tree_taxa", cte("order_leaves", f"SELECT DISTINCT run, 't' || t AS taxon FROM order_leaves {_RUN}"))
def _(spark, d):
    return tidy(tt.tree_taxa(t.newick_ord(spark, d)))


@register("node_depths", cte(
    "geo",
    f", x AS (SELECT 's' || s AS node, 0 AS height, 0.1 AS path, 1 AS size FROM geo UNION ALL SELECT 'n' || n, 1, 0.2, count(*) FROM geo GROUP BY n "
    f"UNION ALL SELECT 'r' || r, 2, 0.3, count(*) FROM geo GROUP BY r UNION ALL SELECT 'root', 3, 0.3, count(*) FROM geo) SELECT node, height::BIGINT AS height, {rnd('path', 'path')}, size::BIGINT AS size FROM x",
))
def _(spark, d):
    return tidy(tt.node_depths(t.tree_geo(spark, d), []).select("node", "height", "path", "size"))


@register("mrca_labels", cte(
    "geo",
    ", g AS (SELECT *, s::VARCHAR AS x FROM geo) SELECT 's' || s AS node, x AS leftmost, x AS rightmost FROM g UNION ALL SELECT 'n' || n, arg_min(x, s), arg_max(x, s) FROM g GROUP BY n "
    "UNION ALL SELECT 'r' || r, arg_min(x, (n, s)), arg_max(x, (n, s)) FROM g GROUP BY r UNION ALL SELECT 'root', arg_min(x, (r, n, s)), arg_max(x, (r, n, s)) FROM g",
))
def _(spark, d):
    return tidy(tt.mrca_labels(t.tree_geo(spark, d), []).select("node", "leftmost", "rightmost"))


@register("to_newick", cte(
    "geo",
    ", l AS (SELECT n, r, min(s::VARCHAR) AS f, '(' || string_agg(s::VARCHAR || ':0.100000', ',' ORDER BY s::VARCHAR) || '):0.100000' AS x FROM geo GROUP BY 1, 2), "
    "m AS (SELECT r, min(f) AS f, '(' || string_agg(x, ',' ORDER BY f) || '):0.100000' AS x FROM l GROUP BY 1) "
    "SELECT 'geo' AS tree_id, '(' || string_agg(x, ',' ORDER BY f) || ');' AS newick FROM m",
))
def _(spark, d):
    return tidy(tt.to_newick(t.tree_geo(spark, d).withColumn("tree_id", F.lit("geo")), ["tree_id"]))


@register("register_tree", cte(
    "geo",
    ", k AS (SELECT g.* FROM geo g JOIN supplier ON s_suppkey = s WHERE s_acctbal > 3000), nk AS (SELECT n, r, count(*) AS c FROM k GROUP BY 1, 2), rk AS (SELECT r, count(*) AS c FROM nk GROUP BY 1), "
    "leaf AS (SELECT 's' || k.s AS node, CASE WHEN nk.c > 1 THEN 'n' || k.n WHEN rk.c > 1 THEN 'r' || k.r ELSE 'root' END AS parent, k.s::VARCHAR AS taxon, "
    "CASE WHEN nk.c > 1 THEN 0.1 WHEN rk.c > 1 THEN 0.2 ELSE 0.3 END AS length FROM k JOIN nk USING (n) JOIN rk ON rk.r = k.r), "
    "nat AS (SELECT 'n' || n, CASE WHEN rk.c > 1 THEN 'r' || nk.r ELSE 'root' END, NULL, CASE WHEN rk.c > 1 THEN 0.1 ELSE 0.2 END FROM nk JOIN rk USING (r) WHERE nk.c > 1), "
    "x AS (SELECT * FROM leaf UNION ALL SELECT * FROM nat UNION ALL SELECT 'r' || r, 'root', NULL, 0.1 FROM rk WHERE c > 1 UNION ALL SELECT 'root', NULL, NULL, NULL) "
    f"SELECT node, parent, taxon, {rnd('length', 'length')} FROM x",
))
def _(spark, d):
    """The supplier tree pruned to suppliers with a balance above 3000."""
    data = t.load(spark, d, "supplier").filter(F.col("s_acctbal") > 3000).select(F.col("s_suppkey").alias("taxon"))
    return tidy(tt.register_tree(t.tree_geo(spark, d), data))


@register("missing_map", cte(
    "geo cells_sup",
    ", l AS (SELECT c.site, g.s, g.n, g.r FROM cells_sup c JOIN geo g ON g.s = c.taxon), a AS (SELECT site, n, r, count(*) AS c FROM l GROUP BY 1, 2, 3), b AS (SELECT site, r, count(*) AS c FROM a GROUP BY 1, 2), "
    "ro AS (SELECT site, CASE WHEN count(*) > 1 THEN 2 ELSE 0 END AS mark FROM b GROUP BY 1), "
    "re AS (SELECT b.site, r, CASE WHEN ro.mark > 0 THEN 1 WHEN c > 1 THEN 2 ELSE 0 END AS mark FROM b JOIN ro USING (site)), "
    "na AS (SELECT a.site, n, CASE WHEN re.mark > 0 THEN 1 WHEN c > 1 THEN 2 ELSE 0 END AS mark FROM a JOIN re USING (site, r)), "
    "le AS (SELECT l.site, s, CASE WHEN na.mark > 0 THEN 1 ELSE 2 END AS mark FROM l JOIN na USING (site, n)), "
    "x AS (SELECT 'root' AS node, mark FROM ro UNION ALL SELECT 'r' || r, mark FROM re UNION ALL SELECT 'n' || n, mark FROM na UNION ALL SELECT 's' || s, mark FROM le) "
    "SELECT node, mark::BIGINT AS mark, count(*) AS n FROM x WHERE mark > 0 GROUP BY 1, 2",
))
def _(spark, d):
    """Branches by informative state over all parts."""
    found = tt.missing_map(t.cells_sup(spark, d), t.tree_geo(spark, d))
    return tidy(found.groupBy("node", "mark").agg(F.count(F.lit(1)).alias("n")))
