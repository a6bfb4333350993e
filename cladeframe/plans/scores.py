"""Cross-validation, wAIC and marginal-likelihood queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe import tables as t
from cladeframe.functions.moments import moment_columns
from cladeframe.operators import fit
from cladeframe.operators.sampling import site_subsets
from cladeframe.plans.views_sql import cte, rnd, tidy

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


_LME = "max(hi) + ln(avg(exp({0} - hi)))"
_ESS = "sum(exp({0} - hi)) ^ 2 / sum(exp(2 * ({0} - hi)))"


@register("log_mean_exp", (
    "WITH x AS (SELECT o_custkey AS k, o_totalprice / 1000 AS v, max(o_totalprice / 1000) OVER (PARTITION BY o_custkey) AS hi FROM orders) "
    f"SELECT k, {rnd(_LME.format('v'), 'log_mean_exp')}, {rnd(_ESS.format('v'), 'ess')} FROM x GROUP BY 1"
))
def _(spark, d):
    """Log-scale mean and importance ESS over values that spread over several bands."""
    from cladeframe.functions.logspace import log_moments

    x = t.load(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_totalprice") / 1000).alias("v"))
    return tidy(log_moments(x, ["k"], "v").select("k", "log_mean_exp", "ess"))


@register("cv_score", cte(
    "logl_li",
    ", x AS (SELECT run, iter, sum(logl) AS s FROM logl_li GROUP BY 1, 2), y AS (SELECT *, max(s) OVER (PARTITION BY run) AS hi FROM x) "
    f"SELECT run, count(*) AS n_draws, {rnd(_LME.format('s'), 'cv', 5)}, {rnd(_ESS.format('s'), 'ess', 5)}, {rnd('avg(s)', 'mean_score', 5)}, {rnd('var_pop(s)', 'var_score', 2)} FROM y GROUP BY 1",
))
def _(spark, d):
    return tidy(fit.cv_score(t.logl_li(spark, d)), 5, var_score=2)


@register("site_cv", cte("scores", f"SELECT run, site, {rnd('logpostmeanl', 'cv')}, {rnd('ess_l', 'ess')} FROM scores"))
def _(spark, d):
    return tidy(fit.site_cv(t.logl_plain(spark, d)))


@register("site_cv_summary", cte(
    "scores",
    f"SELECT run, count(*) AS n_sites, {rnd('avg(logpostmeanl)', 'mean_cv')}, {rnd('avg(ess_l)', 'mean_ess')}, {rnd('avg((ess_l < 10)::INT)', 'frac_low_ess')}, {rnd('count(*) * avg(logpostmeanl)', 'total_cv', 4)} FROM scores GROUP BY 1",
))
def _(spark, d):
    return tidy(fit.site_cv_summary(fit.site_cv(t.logl_plain(spark, d))), total_cv=4)


@register("site_scores", cte("scores", "SELECT run, site, n, " + ", ".join(rnd(c, c) for c in ("logl", "var", "logcpo", "ess_cpo", "logpostmeanl", "ess_l")) + " FROM scores"))
def _(spark, d):
    return tidy(fit.site_scores(t.logl_plain(spark, d)))


@register("run_fit", cte(
    "scores",
    f"SELECT run, {rnd('avg(logpostmeanl) - avg(var)', 'waic')}, {rnd('avg(ess_l)', 'waic_ess')}, {rnd('avg((ess_l < 10)::INT)', 'waic_low_ess')}, "
    f"{rnd('avg(logcpo)', 'loocv')}, {rnd('avg(ess_cpo)', 'loocv_ess')}, {rnd('avg((ess_cpo < 10)::INT)', 'loocv_low_ess')} FROM scores GROUP BY 1",
))
def _(spark, d):
    return tidy(fit.run_fit(fit.site_scores(t.logl_plain(spark, d))))


_T95 = "CASE n_runs WHEN 2 THEN tan(pi() * 0.475) WHEN 3 THEN 0.95 * sqrt(2 / (4 * 0.975 * 0.025)) END"


def _loocv(lowest: str) -> str:
    return cte(
        "scores",
        f", st AS (SELECT site, var_samp(logcpo) AS v_l, avg(ess_cpo) AS e_l, {lowest} AS s_l, var_samp(logpostmeanl) AS v_w, avg(ess_l) AS e_w, avg(logpostmeanl - var) AS s_w FROM scores GROUP BY 1), "
        "rn AS (SELECT run, avg(logcpo) AS l, avg(logpostmeanl) - avg(var) AS w FROM scores GROUP BY 1), "
        "r AS (SELECT count(*) AS n_runs, avg(l) AS ml, stddev_samp(l) AS sl, avg(w) AS mw, stddev_samp(w) AS sw FROM rn), "
        "s AS (SELECT count(*) AS n_sites, avg(v_l) AS v_l, avg(e_l) AS e_l, avg((e_l < 10)::INT) AS low_l, avg(CASE WHEN e_l < 10 THEN s_l ELSE 0 END) AS f_l, "
        "avg(v_w) AS v_w, avg(e_w) AS e_w, avg((e_w < 10)::INT) AS low_w, avg(CASE WHEN e_w < 10 THEN s_w ELSE 0 END) AS f_w FROM st), "
        f"a AS (SELECT *, {_T95} AS t95 FROM r, s), "
        "x AS (SELECT 'loocv' AS score_name, ml - 0.5 * v_l AS score, 0.5 * v_l AS bias, sl AS stdev, t95 * sl AS m, e_l AS mean_ess, low_l AS frac_low_ess, abs(f_l / ml) AS score_low_ess, n_runs, n_sites FROM a "
        "UNION ALL SELECT 'waic', mw + 0.5 * v_w, -0.5 * v_w, sw, t95 * sw, e_w, low_w, abs(f_w / mw), n_runs, n_sites FROM a) "
        f"SELECT score_name, {rnd('score', 'score')}, {rnd('bias', 'bias')}, {rnd('stdev', 'stdev')}, {rnd('score - m', 'ci_low', 5)}, {rnd('score + m', 'ci_high', 5)}, "
        f"{rnd('mean_ess', 'mean_ess')}, {rnd('frac_low_ess', 'frac_low_ess')}, {rnd('score_low_ess', 'score_low_ess')}, n_runs, n_sites FROM x",
    )


@register("loocv_waic", _loocv("avg(logcpo)"))
def _(spark, d):
    return tidy(fit.loocv_waic(fit.site_scores(t.logl_plain(spark, d))), ci_low=5, ci_high=5)


@register("loocv_waic_last_run", _loocv("arg_max(logcpo, run)"))
def _(spark, d):
    return tidy(fit.loocv_waic(fit.site_scores(t.logl_plain(spark, d)), last_run=True), ci_low=5, ci_high=5)


@register("stepping_estimate", cte("stepping", "SELECT run, cycle, npoint, " + ", ".join(rnd(c, c) for c in ("logz", "meanlogp", "meanlogprior", "varlogp", "ess")) + " FROM stepping"))
def _(spark, d):
    return tidy(fit.stepping_estimate(t.stepping_li(spark, d)))


@register("stepping_target", cte(
    "stepping", "SELECT run, cycle, (CASE WHEN varlogp > 1.9 THEN floor(least(100 * exp(varlogp - 1.9), 130)) ELSE 100 END)::BIGINT AS target FROM stepping"
))
def _(spark, d):
    return tidy(fit.stepping_target(fit.stepping_estimate(t.stepping_li(spark, d)), 100, 1.9, 130).select("run", "cycle", "target"))


@register("marginal_likelihood", cte(
    "stepping",
    ", c AS (SELECT cycle, var_samp(logz) AS v, avg(ess) AS e FROM stepping GROUP BY 1), q AS (SELECT run, avg(logz) AS z FROM stepping GROUP BY 1), "
    "a AS (SELECT (SELECT count(*) FROM c) AS n_sites, (SELECT count(*) FROM q) AS n_runs, (SELECT avg(v) FROM c) AS v, (SELECT avg(e) FROM c) AS mean_ess, "
    "(SELECT count(*) FILTER (e < 10) FROM c) AS n_low_ess, (SELECT avg(z) FROM q) AS score), "
    f"b AS (SELECT *, score + 0.5 * v AS debiased, sqrt(v / n_sites / n_runs) AS stdev, {_T95} AS t95 FROM a) "
    f"SELECT n_sites, n_runs, {rnd('score', 'score')}, {rnd('debiased', 'debiased')}, {rnd('debiased - t95 * stdev', 'ci_low', 5)}, {rnd('debiased + t95 * stdev', 'ci_high', 5)}, "
    f"{rnd('-0.5 * v', 'bias')}, {rnd('stdev', 'stdev')}, {rnd('mean_ess', 'mean_ess')}, n_low_ess FROM b",
))
def _(spark, d):
    return tidy(fit.marginal_likelihood(fit.stepping_estimate(t.stepping_li(spark, d))), ci_low=5, ci_high=5)


CURVE = [(1, 6), (2, 5), (5, 4), (11, 3), (101, 2)]


def subset_sql(sizes) -> str:
    values = ", ".join(f"({k}, {r})" for k, r in sizes)
    return (
        ", sites AS (SELECT DISTINCT l_partkey AS site FROM lineitem), "
        f"sub AS (SELECT k, rep, site FROM (SELECT k, rep, site, row_number() OVER (PARTITION BY k, rep ORDER BY md5('5-' || k || '-' || rep || '-' || site)) AS r "
        f"FROM sites CROSS JOIN (SELECT k, unnest(range(r)) AS rep FROM (VALUES {values}) v(k, r))) WHERE r <= k) "
    )


@register("cv_subset_curve", cte(
    "logl_li",
    subset_sql(CURVE)
    + ", tt AS (SELECT run, k, rep, iter, sum(logl) AS s FROM logl_li JOIN sub USING (site) GROUP BY 1, 2, 3, 4), h AS (SELECT *, max(s) OVER (PARTITION BY run, k, rep) AS hi FROM tt), "
    f"g AS (SELECT run, k, rep, count(*) AS n, {_LME.format('s')} AS l, {_ESS.format('s')} AS e, avg(s) AS m, var_pop(s) AS v FROM h GROUP BY 1, 2, 3) "
    f"SELECT run, k::BIGINT AS k, count(*) AS n_subsets, {rnd('avg(l / k)', 'cv', 5)}, {rnd('avg((n / e - 1) / 2 / n)', 'bias')}, {rnd('avg((n / e - 1) / n)', 'var')}, "
    f"{rnd('ln(1 + avg((exp(v) - 1) / n))', 'var_lognormal', 4)}, {rnd('avg(m)', 'mean_logl', 4)}, {rnd('avg(v)', 'var_logl', 3)}, {rnd('avg(e)', 'mean_ess', 5)}, {rnd('min(e)', 'min_ess', 5)} FROM g GROUP BY 1, 2",
))
def _(spark, d):
    """Cross-validation curve over a few subset sizes of all parts.

    The lognormal variance grows with the exponential of a variance, so it is shown on the log scale.
    """
    logl = t.logl_li(spark, d)
    curve = fit.cv_subset_curve(logl, site_subsets(logl, CURVE, 5)).withColumn("var_lognormal", F.log(1 + F.col("var_lognormal")))
    return tidy(curve, cv=5, var_lognormal=4, mean_logl=4, var_logl=3, mean_ess=5, min_ess=5)


@register("site_subsets", cte("logl_li", subset_sql(CURVE) + "SELECT k::BIGINT AS k, rep, site FROM sub"))
def _(spark, d):
    return tidy(site_subsets(t.logl_plain(spark, d), CURVE, 5))


@register("truncate_mixture", (
    "WITH w AS (SELECT l_linenumber::BIGINT AS iter, l_suppkey AS comp, count(*) / sum(count(*)) OVER (PARTITION BY l_linenumber) AS w FROM lineitem GROUP BY l_linenumber, l_suppkey) "
    f"SELECT 'li' AS run, iter, comp, {rnd('w', 'w', 8)} FROM (SELECT *, coalesce(sum(w) OVER (PARTITION BY iter ORDER BY comp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM w) WHERE d >= 0.1234567"
))
def _(spark, d):
    """Suppliers as mixture components, weights from their lines."""
    counts = t.lineitem(spark, d).groupBy(F.col("l_linenumber").alias("iter"), F.col("l_suppkey").alias("comp")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("iter").agg(F.sum("n").alias("t"))
    weights = counts.join(totals, "iter").select(F.lit("li").alias("run"), "iter", "comp", (F.col("n") / F.col("t")).alias("w"))
    return tidy(fit.truncate_mixture(weights, 0.1234567), 8)


@register("moments", (
    "SELECT l_returnflag AS k, " + ", ".join([
        rnd("avg(l_quantity)", "mean_x"), rnd("avg(l_extendedprice)", "mean_y", 4), rnd("var_pop(l_quantity)", "var_x"), rnd("var_samp(l_quantity)", "unbiased_var_x"),
        rnd("covar_pop(l_quantity, l_extendedprice)", "covar", 3), rnd("corr(l_quantity, l_extendedprice)", "correl"),
    ]) + " FROM lineitem GROUP BY 1"
))
def _(spark, d):
    out = t.lineitem(spark, d).groupBy(F.col("l_returnflag").alias("k")).agg(*moment_columns("l_quantity", "l_extendedprice"))
    return tidy(out, mean_y=4, covar=3)


@register("student95", cte(
    "stepping",
    f"SELECT cycle, count(*) AS n_runs, {rnd('avg(logz) - ' + _T95.replace('n_runs', 'count(*)') + ' * stddev_samp(logz) / sqrt(count(*))', 'ci_low', 5)} FROM stepping GROUP BY 1",
))
def _(spark, d):
    """Student limits of every cycle over the runs."""
    from cladeframe.functions.student import t95

    cycles = fit.stepping_estimate(t.stepping_li(spark, d)).groupBy("cycle").agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("logz").alias("m"), F.stddev_samp("logz").alias("s")
    )
    joined = cycles.filter("n_runs > 1").withColumn("t95", t95(F.col("n_runs") - 1))
    return tidy(joined.select("cycle", "n_runs", (F.col("m") - F.col("t95") * F.col("s") / F.sqrt("n_runs")).alias("ci_low")), 5)
