"""Trace diagnostics and posterior summaries of draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe import tables as t
from cladeframe.operators import posterior as po
from cladeframe.operators import trace as tr
from cladeframe.plans.views_sql import cte, rnd, tidy

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


SUMMARY = "SELECT run, param, count(*) AS n, " + rnd("sum(value)", "total", 4) + ", min(iter) AS first_iter, max(iter) AS last_iter FROM {0} GROUP BY 1, 2"


def summary(trace):
    return trace.groupBy("run", "param").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.min("iter").alias("first_iter"), F.max("iter").alias("last_iter")
    )


@register("trace_points", cte("trace_ev", "SELECT run, iter, param, " + rnd("value", "value") + " FROM trace_ev"))
def _(spark, d):
    """Iteration numbers given at ingest."""
    return tidy(t.event_trace(spark, d))


@register("thin", cte("trace_ev", ", c AS (SELECT * FROM trace_ev WHERE iter >= 100 AND iter < 1500 AND (iter - 100) % 7 = 0) " + SUMMARY.format("c")))
def _(spark, d):
    return tidy(summary(tr.thin(t.event_trace(spark, d), 100, 7, 1500)), 4)


@register("align_traces", cte(
    "trace_ev",
    ", l AS (SELECT min(n) AS n FROM (SELECT run, max(iter) + 1 AS n FROM trace_ev GROUP BY 1)), "
    "c AS (SELECT run, iter - n // 5 AS iter, param, value FROM trace_ev, l WHERE iter >= n // 5 AND iter < n) " + SUMMARY.format("c"),
))
def _(spark, d):
    return tidy(summary(tr.align_traces(t.event_trace(spark, d))), 4)


_MOMENTS = "SELECT run, param, count(*) AS n, avg(value) AS mean, var_samp(value) AS variance, min(value) = max(value) AS is_constant FROM {0} GROUP BY 1, 2"


@register("trace_moments", cte("trace_ev", f"SELECT run, param, n, {rnd('mean', 'mean')}, {rnd('variance', 'variance')}, is_constant FROM ({_MOMENTS.format('trace_ev')})"))
def _(spark, d):
    return tidy(tr.trace_moments(t.event_trace(spark, d)))


def acf_sql(src: str) -> str:
    return (
        f", mo AS ({_MOMENTS.format(src)}), y AS (SELECT x.run, x.param, x.iter, mo.n, mo.variance, x.value - mo.mean AS y FROM {src} x JOIN mo USING (run, param)), "
        "acf AS (SELECT a.run, a.param, a.n, b.iter - a.iter AS lag, sum(a.y * b.y) / a.n AS autocov, sum(a.y * b.y) / (any_value(a.variance) * (a.n - 1)) AS rho "
        "FROM y a JOIN y b ON a.run = b.run AND a.param = b.param AND b.iter >= a.iter AND b.iter - a.iter < a.n // 2 GROUP BY 1, 2, 3, 4), "
        "ess AS (SELECT run, param, CASE WHEN 1 + 2 * s < 1 THEN n::DOUBLE ELSE n / (1 + 2 * s) END AS ess FROM ("
        "SELECT run, param, n, sum(CASE WHEN lag > 0 THEN 0.5 * (1 + cos(2 * pi() * lag / n)) * rho ELSE 0 END) AS s FROM acf GROUP BY 1, 2, 3)) "
    )


@register("autocorrelation", cte("trace_user", acf_sql("trace_user") + f"SELECT run, param, n, lag, {rnd('autocov', 'autocov', 5)}, {rnd('rho', 'rho')} FROM acf"))
def _(spark, d):
    return tidy(tr.autocorrelation(t.event_trace(spark, d, "user_id")), autocov=5)


@register("autocorrelation_long", cte("trace_ev", acf_sql("trace_ev") + f"SELECT run, param, n, lag, {rnd('autocov', 'autocov', 5)}, {rnd('rho', 'rho')} FROM acf"))
def _(spark, d):
    """The split transform, as it runs on series too long for one task."""
    return tidy(tr.autocorrelation(t.event_trace(spark, d), short=100), autocov=5)


@register("effective_size", cte("trace_ev", acf_sql("trace_ev") + f"SELECT run, param, {rnd('ess', 'ess', 5)} FROM ess"))
def _(spark, d):
    return tidy(tr.effective_size(t.event_trace(spark, d)), 5)


def order_sql(src: str, keys: str, low: str, high: str) -> str:
    return (
        f"SELECT {keys}, max(CASE WHEN r = {low} THEN value END) AS ci_low, max(CASE WHEN r = {high} THEN value END) AS ci_high, avg(value) AS mean FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}) GROUP BY ALL"
    )


# the half width as in double arithmetic: 0.5 * (1 - 0.95)
_HALF = "(0.5 * (1 - 0.95::DOUBLE))"
_CI = (f"floor({_HALF} * n)", f"floor(n - {_HALF} * n) - 1")


@register("credible_interval", cte("trace_user", f"SELECT run, param, {rnd('ci_low', 'ci_low')}, {rnd('ci_high', 'ci_high')} FROM ({order_sql('trace_user', 'run, param', *_CI)})"))
def _(spark, d):
    return tidy(tr.credible_interval(t.event_trace(spark, d, "user_id")))


@register("trace_ci", cte(
    "trace_ev", f"SELECT run, param, {rnd('mean', 'mean')}, {rnd('ci_low', 'ci_low')}, {rnd('ci_high', 'ci_high')} FROM ("
    + order_sql("trace_ev", "run, param", "floor(n * 0.05::DOUBLE)", "least(floor(n * (1 - 0.05::DOUBLE)), n - 1)") + ")",
))
def _(spark, d):
    return tidy(tr.trace_ci(t.event_trace(spark, d)))


_REPORT = acf_sql("trace_ev") + f", ci AS ({order_sql('trace_ev', 'run, param', *_CI)}), rep AS (SELECT mo.run, mo.param, mo.n, mo.mean, sqrt(variance) AS sd, sqrt(variance / ess) AS se, ess, ci_low, ci_high, variance FROM mo JOIN ess USING (run, param) JOIN ci USING (run, param)) "


@register("trace_report", cte(
    "trace_ev", _REPORT + "SELECT run, param, n, " + ", ".join(rnd(c, c, 5) for c in ("mean", "sd", "se", "ess", "ci_low", "ci_high", "variance")) + " FROM rep"
))
def _(spark, d):
    return tidy(tr.trace_report(t.event_trace(spark, d)), 5)


_PAIRS = (
    ", pairs AS (SELECT a.param, CASE WHEN least(a.ci_high, b.ci_high) < greatest(a.ci_low, b.ci_low) THEN 0 WHEN greatest(a.ci_high, b.ci_high) = least(a.ci_low, b.ci_low) THEN 100 "
    "ELSE 100 * (least(a.ci_high, b.ci_high) - greatest(a.ci_low, b.ci_low)) / (greatest(a.ci_high, b.ci_high) - least(a.ci_low, b.ci_low)) END AS overlap "
    "FROM rep a JOIN rep b ON a.param = b.param AND a.run < b.run), "
    "cmp AS (SELECT param, count(*) AS n_runs, CASE WHEN avg(CASE WHEN variance > 1e-12 THEN sd ELSE 0 END) > 1e-12 THEN (max(mean) - min(mean)) / avg(CASE WHEN variance > 1e-12 THEN sd ELSE 0 END) ELSE 0 END AS rel_diff, "
    "avg(ess) AS mean_ess, (SELECT max(overlap) FROM pairs p WHERE p.param = rep.param) AS max_overlap FROM rep GROUP BY 1) "
)


@register("compare_runs_traces", cte(
    "trace_ev", _REPORT + _PAIRS + f"SELECT param, n_runs, {rnd('rel_diff', 'rel_diff')}, {rnd('mean_ess', 'mean_ess', 5)}, {rnd('max_overlap', 'max_overlap')} FROM cmp"
))
def _(spark, d):
    return tidy(tr.compare_runs_traces(tr.trace_report(t.event_trace(spark, d))), mean_ess=5)


@register("overall_convergence", cte(
    "trace_ev", _REPORT + _PAIRS + f"SELECT {rnd('max(rel_diff)', 'max_rel_diff')}, {rnd('min(mean_ess)', 'min_ess', 5)}, {rnd('min(max_overlap)', 'min_overlap')} FROM cmp"
))
def _(spark, d):
    whole = tr.overall_convergence(tr.compare_runs_traces(tr.trace_report(t.event_trace(spark, d))))
    return tidy(whole, min_ess=5)


@register("overlap_histogram", cte(
    "trace_ev", _REPORT + _PAIRS + "SELECT greatest(ceil(overlap / 5) - 1, 0)::BIGINT AS bin, count(*) AS n FROM pairs GROUP BY 1"
))
def _(spark, d):
    return tidy(tr.overlap_histogram(tr.pair_overlaps(tr.trace_report(t.event_trace(spark, d)))))


_DRAWS = "SELECT 'alpha' AS param, o_totalprice / 100000 AS value FROM orders UNION ALL SELECT 'kappa', (o_custkey % 97)::DOUBLE FROM orders"


@register("posterior_summary", (
    f"WITH x AS ({_DRAWS}) SELECT param, {rnd('mean', 'mean')}, {rnd('ci_low', 'ci_low')}, {rnd('ci_high', 'ci_high')} FROM (" + order_sql("x", "param", *_CI) + ")"
))
def _(spark, d):
    return tidy(po.posterior_summary(t.draws_ord(spark, d), ["alpha", "kappa"]))


@register("posterior_summary_tail", (
    f"WITH x AS ({_DRAWS}) SELECT param, {rnd('mean', 'mean')}, {rnd('ci_low', 'ci_low')}, {rnd('ci_high', 'ci_high')} FROM ("
    + order_sql("x", "param", "floor(n * 0.05::DOUBLE)", "least(floor(n * (1 - 0.05::DOUBLE)), n - 1)") + ")"
))
def _(spark, d):
    return tidy(po.posterior_summary(t.draws_ord(spark, d), ["alpha", "kappa"], tail=0.05))


@register("posterior_hyper", (
    f"WITH x AS ({_DRAWS}) SELECT param, {rnd('avg(value) ^ 2 / var_pop(value)', 'shape')}, {rnd('avg(value) / var_pop(value)', 'rate')} FROM x GROUP BY 1"
))
def _(spark, d):
    long = t.draws_ord(spark, d).unpivot(["run", "iter"], ["alpha", "kappa"], "param", "value")
    return tidy(po.posterior_hyper(long, ["param"]))


@register("dirichlet_concentration", cte(
    "comp_models",
    ", x AS (SELECT unnest(['A', 'N', 'R']) AS state, unnest([pa, pn, pr]) AS value FROM comp_models), m AS (SELECT state, avg(value) AS m, var_pop(value) AS v FROM x GROUP BY 1) "
    f"SELECT state, {rnd('((SELECT sum(m * (1 - m)) / sum(v) FROM m) - 1) * m', 'weight', 4)} FROM m",
))
def _(spark, d):
    pi = t.flag_profiles(spark, d, F.col("l_linenumber")).select(
        F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in t.FLAGS]).alias("state"), F.col("pi").alias("value"))).alias("p")
    )
    return tidy(po.dirichlet_concentration(pi.select(F.col("p")["state"].alias("state"), F.col("p")["value"].alias("value"))), 4)


@register("mean_site_profiles", cte("alloc_li prof_li", f"SELECT site, state, {rnd('avg(freq)', 'freq')} FROM alloc_li JOIN prof_li USING (iter, comp) GROUP BY 1, 2"))
def _(spark, d):
    return tidy(po.mean_site_profiles(t.alloc_li(spark, d), t.prof_li(spark, d)))


@register("mean_exchangeabilities", cte("rr_li", f"SELECT s1, s2, {rnd('avg(v)', 'value')} FROM (SELECT s1, s2, value / avg(value) OVER (PARTITION BY iter) AS v FROM rr_li) GROUP BY 1, 2"))
def _(spark, d):
    return tidy(po.mean_exchangeabilities(t.rr_li(spark, d)))


_SIZES = "SELECT iter, comp, count(*) AS n FROM alloc_li GROUP BY 1, 2"
_CLUSTERS = f"SELECT iter, count(*) AS n_occupied, sum(n) ^ 2 / sum(n * n) AS n_effective FROM ({_SIZES}) GROUP BY 1"


@register("cluster_counts", cte("alloc_li", f"SELECT 'li' AS run, iter, n_occupied, {rnd('n_effective', 'n_effective')} FROM ({_CLUSTERS})"))
def _(spark, d):
    return tidy(po.cluster_counts(t.alloc_li(spark, d)))


@register("cluster_summary", cte(
    "alloc_li",
    f"SELECT 'li' AS run, {rnd('avg(n_occupied)', 'mean_occupied')}, {rnd('stddev_pop(n_occupied)', 'sd_occupied')}, {rnd('avg(n_effective)', 'mean_effective')}, {rnd('stddev_pop(n_effective)', 'sd_effective')} FROM ({_CLUSTERS})",
))
def _(spark, d):
    return tidy(po.cluster_summary(po.cluster_counts(t.alloc_li(spark, d))))


@register("profile_entropy", cte("prof_li", f"SELECT 'li' AS run, iter, comp, {rnd('sum(CASE WHEN freq > 0 THEN -freq * ln(freq) ELSE 0 END)', 'entropy')} FROM prof_li GROUP BY 2, 3"))
def _(spark, d):
    return tidy(po.profile_entropy(t.prof_li(spark, d)))


@register("mean_profile_entropy", cte(
    "alloc_li prof_li",
    f"SELECT 'li' AS run, iter, {rnd('sum(e * n) / sum(n)', 'mean_entropy')} FROM (SELECT iter, comp, sum(CASE WHEN freq > 0 THEN -freq * ln(freq) ELSE 0 END) AS e FROM prof_li GROUP BY 1, 2) JOIN ({_SIZES}) USING (iter, comp) GROUP BY 2",
))
def _(spark, d):
    return tidy(po.mean_profile_entropy(t.prof_li(spark, d), t.alloc_li(spark, d)))


@register("center_entropy", (
    "WITH x AS (SELECT l_linenumber::BIGINT AS iter, l_returnflag AS state, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2) "
    f"SELECT 'li' AS run, iter, {rnd('-sum(p * ln(p))', 'entropy')} FROM (SELECT iter, value / sum(value) OVER (PARTITION BY iter) AS p FROM x) GROUP BY 2"
))
def _(spark, d):
    centre = t.lineitem(spark, d).groupBy(F.lit("li").alias("run"), F.col("l_linenumber").alias("iter"), F.col("l_returnflag").alias("state")).agg(F.sum("l_quantity").alias("value"))
    return tidy(po.center_entropy(centre))


@register("rr_entropy", cte(
    "rr_li",
    f"SELECT 'li' AS run, iter, {rnd('sum(CASE WHEN p > 1e-6 THEN -p * ln(p) ELSE 0 END)', 'entropy')}, {rnd('var_pop(value) / avg(value) ^ 2', 'var_coeff', 8)} "
    "FROM (SELECT iter, value, value / sum(value) OVER (PARTITION BY iter) AS p FROM rr_li) GROUP BY 2",
))
def _(spark, d):
    out = po.rr_entropy(t.rr_li(spark, d))
    return tidy(out, var_coeff=8)


@register("tree_length", (
    f"SELECT o_orderstatus AS run, l_orderkey AS iter, {rnd('sum(l_discount) * 1.5', 'tree_length')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"
))
def _(spark, d):
    """Discounts as branch lengths of one tree per order."""
    from cladeframe.operators.trees import tree_length

    orders = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("iter"), F.col("o_orderstatus").alias("run"))
    lengths = t.lineitem(spark, d).select(F.col("l_orderkey").alias("iter"), F.col("l_discount").alias("length"))
    return tidy(tree_length(lengths.join(orders, "iter"), 1.5))


def _ppred_stats(cells_sql: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else "0 AS rep, "
    site = (
        f"SELECT {k}site, count(*) AS k, sum(f * f) AS q, " + ", ".join(f"sum(CASE WHEN state = '{s}' THEN f ELSE 0 END) AS f{i}" for i, s in enumerate(t.EVENT_TYPES))
        + f" FROM (SELECT {k}site, state, count(*) / sum(count(*)) OVER (PARTITION BY {k}site) AS f FROM {cells_sql} GROUP BY {k}site, state) GROUP BY {k}site"
    )
    var = " + ".join(f"var_pop(f{i})" for i in range(5))
    return f"SELECT {lead}avg(k) AS d, avg(q) AS q, ({var}) / 5 AS v FROM ({site}) {g}"


def _ppred_dist(cells_sql: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    fs = ", ".join(f"sum((state = '{s}')::INT) / count(*)::DOUBLE AS f{i}" for i, s in enumerate(t.EVENT_TYPES))
    over = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    dist = " + ".join(f"(f{i} - avg(f{i}) {over}) ^ 2" for i in range(5))
    return f"SELECT {k}taxon, {dist} AS dist FROM (SELECT {k}taxon, {fs} FROM {cells_sql} GROUP BY {k}taxon)"


def _stats_long(spark, d, cells, keys):
    from cladeframe.operators import composition as co

    het = co.heterogeneity_summary(co.composition_heterogeneity(cells, t.EVENT_TYPES, keys), keys)
    stats = co.site_statistics(cells, t.EVENT_TYPES, keys)
    names = ["mean_diversity", "mean_squared_freq", "mean_freq_variance"]
    if keys:
        wide = stats.join(het, keys)
        return wide.unpivot(keys, [*names, "max_dist", "mean_dist"], "stat", "value")
    return stats.unpivot([], names, "stat", "value").unionByName(het.unpivot([], ["max_dist", "mean_dist"], "stat", "value"))


@register("ppred_test", cte(
    "cells_ev cells_rep",
    f", os AS ({_ppred_stats('cells_ev', '')}), oh AS (SELECT max(dist) AS m, avg(dist) AS a FROM ({_ppred_dist('cells_ev', '')})), "
    f"rs AS ({_ppred_stats('cells_rep', 'rep')}), rh AS (SELECT rep, max(dist) AS m, avg(dist) AS a FROM ({_ppred_dist('cells_rep', 'rep')}) GROUP BY 1), "
    "o AS (SELECT 'mean_diversity' AS stat, d AS obs FROM os UNION ALL SELECT 'mean_squared_freq', q FROM os UNION ALL SELECT 'mean_freq_variance', v FROM os UNION ALL SELECT 'max_dist', m FROM oh UNION ALL SELECT 'mean_dist', a FROM oh), "
    "r AS (SELECT 'mean_diversity' AS stat, d AS value FROM rs UNION ALL SELECT 'mean_squared_freq', q FROM rs UNION ALL SELECT 'mean_freq_variance', v FROM rs UNION ALL SELECT 'max_dist', m FROM rh UNION ALL SELECT 'mean_dist', a FROM rh), "
    "a AS (SELECT stat, any_value(obs) AS obs, avg(value) AS mean, stddev_pop(value) AS sd, avg((value > obs)::INT) AS hi, avg((value < obs)::INT) AS lo, count(*) FILTER (value = obs) AS ties FROM r JOIN o USING (stat) GROUP BY 1) "
    f"SELECT stat, {rnd('obs', 'obs')}, {rnd('mean', 'mean')}, {rnd('sd', 'sd')}, {rnd('CASE WHEN stat = $$mean_diversity$$ THEN mean - obs ELSE obs - mean END / sd', 'z', 4)}, "
    f"{rnd('CASE WHEN stat = $$mean_diversity$$ THEN lo ELSE hi END', 'p')}, ties FROM a",
))
def _(spark, d):
    """Composition statistics of ten replicate alignments against the observed one."""
    obs = _stats_long(spark, d, t.cells_ev(spark, d), [])
    reps = _stats_long(spark, d, t.cells_rep(spark, d), ["rep"])
    return tidy(po.ppred_test(obs, reps), z=4)


@register("ppred_taxa", cte(
    "cells_ev cells_rep",
    f", o AS ({_ppred_dist('cells_ev', '')}), r AS ({_ppred_dist('cells_rep', 'rep')}) "
    f"SELECT taxon, {rnd('any_value(o.dist)', 'obs')}, {rnd('avg(r.dist)', 'mean')}, {rnd('(any_value(o.dist) - avg(r.dist)) / stddev_pop(r.dist)', 'z', 4)}, {rnd('avg((r.dist > o.dist)::INT)', 'pp')} FROM r JOIN o USING (taxon) GROUP BY 1",
))
def _(spark, d):
    from cladeframe.operators.composition import composition_heterogeneity as ch

    obs, reps = ch(t.cells_ev(spark, d), t.EVENT_TYPES), ch(t.cells_rep(spark, d), t.EVENT_TYPES, ["rep"])
    return tidy(po.ppred_taxa(obs, reps), z=4)
