"""Site likelihoods of return flags on the supplier tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe import tables as t
from cladeframe.functions.gamma import gamma_rates
from cladeframe.operators import likelihood as lk
from cladeframe.operators import trees as tt
from cladeframe.operators.composition import site_orbits
from cladeframe.plans.views_sql import cte, pruning_sql, rnd, tidy

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


VIEWS = "cells_sup geo rate_models comp_models"
BY_RATE = pruning_sql("rate_models")
BY_COMP = pruning_sql("comp_models")
LOGL = f"SELECT draw::BIGINT AS draw, site, cat::BIGINT AS cat, {rnd('logl', 'logl')} FROM lk"
PARTS = "(SELECT DISTINCT draw, cat, rate FROM rate_models)"


def solve(spark, d, models, form=lk.site_loglik):
    return form(t.cells_sup(spark, d), t.tree_geo(spark, d), models(spark, d), t.FLAGS)


@register("site_loglik_levels", cte(VIEWS, f", {BY_RATE} {LOGL}"))
def _(spark, d):
    """Level-by-level form with built-ins only."""
    return tidy(solve(spark, d, t.part_models, lk.site_loglik_levels))


@register("site_loglik", cte(VIEWS, f", {BY_RATE} {LOGL}"))
def _(spark, d):
    """Messages of packed blocks, the models the same for all sites."""
    return tidy(solve(spark, d, t.rate_models))


@register("site_loglik_by_site", SQL["site_loglik"])
def _(spark, d):
    """The same with models of their own for every site."""
    return tidy(solve(spark, d, t.part_models))


@register("root_invariance", SQL["site_loglik"])
def _(spark, d):
    """The same likelihoods on the tree rooted above one supplier: the place of the root changes nothing."""
    text = tt.to_newick(t.tree_geo(spark, d).withColumn("t", F.lit(1)), ["t"])
    tree = text.select(F.lit("geo").alias("run"), F.lit(0).cast("bigint").alias("iter"), "newick")
    moved = tt.tree_nodes(tt.reroot(tree, ["1"]).filter("rooted"))
    return tidy(lk.site_loglik(t.cells_sup(spark, d), moved, t.rate_models(spark, d), t.FLAGS))


_MIX = "SELECT draw, site, max(hi) + ln(sum({w} * exp(logl - hi))) AS logl FROM (SELECT *, max(logl) OVER (PARTITION BY draw, site) AS hi FROM lk JOIN {src} USING (draw, cat)) GROUP BY 1, 2"


@register("mixture_site_loglik", cte(
    VIEWS, f", {BY_COMP} SELECT draw::BIGINT AS draw, site, {rnd('logl', 'logl')} FROM ({_MIX.format(w='w', src='(SELECT draw, cat, w FROM comp_models)')})"
))
def _(spark, d):
    """Seven components weighted by their shares of the lines."""
    return tidy(lk.mixture_site_loglik(solve(spark, d, t.comp_models), t.comp_weights(spark, d)))


@register("rate_mixture_loglik", cte(VIEWS, f", {BY_RATE} SELECT draw::BIGINT AS draw, site, {rnd('logl', 'logl')} FROM ({_MIX.format(w='(1 / 3.0::DOUBLE)', src=PARTS)})"))
def _(spark, d):
    return tidy(lk.rate_mixture_loglik(solve(spark, d, t.rate_models), t.rate_weights(spark, d)))


@register("total_loglik", cte(VIEWS, f", {BY_RATE} SELECT draw::BIGINT AS draw, {rnd('sum(logl)', 'total_logl', 4)} FROM ({_MIX.format(w='(1 / 3.0::DOUBLE)', src=PARTS)}) GROUP BY 1"))
def _(spark, d):
    return tidy(lk.total_loglik(lk.rate_mixture_loglik(solve(spark, d, t.rate_models), t.rate_weights(spark, d))), 4)


_RATE = f"SELECT draw, site, sum(rate * exp(logl - hi)) / sum(exp(logl - hi)) AS site_rate FROM (SELECT *, max(logl) OVER (PARTITION BY draw, site) AS hi FROM lk JOIN {PARTS} USING (draw, cat)) GROUP BY 1, 2"


@register("site_rate", cte(VIEWS, f", {BY_RATE} SELECT draw::BIGINT AS draw, site, {rnd('site_rate', 'site_rate')} FROM ({_RATE})"))
def _(spark, d):
    return tidy(lk.site_rate(solve(spark, d, t.rate_models), t.rate_weights(spark, d)))


@register("mean_site_rates", cte(VIEWS, f", {BY_RATE} SELECT site, {rnd('avg(site_rate)', 'mean_rate')} FROM ({_RATE}) GROUP BY 1"))
def _(spark, d):
    return tidy(lk.mean_site_rates(lk.site_rate(solve(spark, d, t.rate_models), t.rate_weights(spark, d))))


def _node_posteriors() -> str:
    """Posterior of root, regions and nations per draw, site and rate, from the up vectors.

    The vector above a child is the product of everything else at its parent, so its
    log is the parent's sum less the child's own term.
    """
    e = "exp(-0.1 * {0}.rate)"

    def carried(a: str, x: str) -> str:
        stay = e.format(a)
        return f"({stay} * {a}.{x} + (1 - {stay}) * ({a}.pa * {a}.xa + {a}.pn * {a}.xn + {a}.pr * {a}.xr))"

    def down(name: str, parent: str, child: str, keys: str) -> str:
        on = " AND ".join(f"p.{k} = c.{k}" for k in keys.split(", "))
        above = ", ".join(f"exp(p.l{k} - ln({carried('c', 'x' + k)}) - p.top) AS u{k}" for k in "anr")
        moved = ", ".join(f"exp(-0.1 * rate) * u{k} + (1 - exp(-0.1 * rate)) * (pa * ua + pn * un + pr * ur) AS d{k}" for k in "anr")
        return f"{name} AS (SELECT *, {moved} FROM (SELECT c.*, {above} FROM {child} c JOIN {parent} p ON {on}))"

    def filled(name: str, src: str, node: str, cols: str) -> str:
        parts = ", ".join([f"coalesce(l{k}, 0) AS l{k}" for k in "anr"] + [f"coalesce(x{k}, 1) AS x{k}" for k in "anr"])
        return (
            f"{name} AS (SELECT q.*, s.site, m.draw, m.cat, m.rate, m.pa, m.pn, m.pr, {parts} FROM (SELECT DISTINCT {cols} FROM geo) q "
            f"CROSS JOIN (SELECT DISTINCT site FROM lk_leaf) s CROSS JOIN rate_models m LEFT JOIN {src} USING ({node}, site, draw, cat))"
        ).replace(f"{src} USING", f"(SELECT {node}, site, draw, cat, la, ln, lr, xa, xn, xr FROM {src}) USING")

    every = filled("fr", "lk_r", "r", "r") + ", " + filled("fn", "lk_n", "n", "n, r")
    top_root = "lk_rt AS (SELECT *, greatest(la, ln, lr) AS top FROM lk_root)"
    regions = down("dn_r", "lk_rt", "fr", "site, draw, cat")
    top_r = "dn_rt AS (SELECT *, " + ", ".join(f"ln(d{k}) + l{k} AS q{k}" for k in "anr") + " FROM dn_r), dn_rq AS (SELECT * EXCLUDE (la, ln, lr), qa AS la, qn AS ln, qr AS lr, greatest(qa, qn, qr) AS top FROM dn_rt)"
    nations = down("dn_n", "dn_rq", "fn", "r, site, draw, cat")
    post = (
        "po AS (SELECT 'root' AS node, draw, site, cat, pa * xa AS ja, pn * xn AS jn, pr * xr AS jr FROM lk_root "
        "UNION ALL SELECT 'r' || r, draw, site, cat, pa * xa * da, pn * xn * dn, pr * xr * dr FROM dn_r "
        "UNION ALL SELECT 'n' || n, draw, site, cat, pa * xa * da, pn * xn * dn, pr * xr * dr FROM dn_n)"
    )
    return ", ".join([every, top_root, regions, top_r, nations, post])


def _ancestral(weighted: bool) -> str:
    weight = "exp(logl - hi)" if weighted else "1"
    return cte(
        VIEWS,
        f", {BY_RATE}, {_node_posteriors()}, "
        "w AS (SELECT po.*, logl, max(logl) OVER (PARTITION BY node, draw, site) AS hi FROM po JOIN lk USING (draw, site, cat)), "
        f"m AS (SELECT node, draw, site, sum({weight} * ja / (ja + jn + jr)) / sum({weight}) AS a, sum({weight} * jn / (ja + jn + jr)) / sum({weight}) AS n, "
        f"sum({weight} * jr / (ja + jn + jr)) / sum({weight}) AS r FROM w GROUP BY 1, 2, 3), "
        "z AS (SELECT node, site, unnest(['A', 'N', 'R']) AS state, unnest([avg(a), avg(n), avg(r)]) AS prob FROM m GROUP BY 1, 2) "
        f"SELECT node, site, state, {rnd('prob', 'prob')} FROM z",
    )


@register("ancestral_probs", _ancestral(True))
def _(spark, d):
    """State probabilities of the inner nodes, categories weighted by their likelihood."""
    return tidy(lk.ancestral_probs(t.cells_sup(spark, d), t.tree_geo(spark, d), t.rate_models(spark, d), t.FLAGS, t.rate_weights(spark, d).select("draw", "cat", "w")))


@register("ancestral_probs_raw_sum", _ancestral(False))
def _(spark, d):
    return tidy(lk.ancestral_probs(t.cells_sup(spark, d), t.tree_geo(spark, d), t.rate_models(spark, d), t.FLAGS, raw_sum=True))


@register("expand_zip", cte(
    "cells_sup comp_models",
    ", pr AS (SELECT unnest(['A', 'N', 'R']) AS state, unnest([avg(pa), avg(pn), avg(pr)]) AS freq FROM comp_models), "
    "s AS (SELECT site, state, count(*) AS n FROM cells_sup GROUP BY 1, 2), tot AS (SELECT site, sum(n) + 1 AS t FROM s GROUP BY 1), "
    "u AS (SELECT tot.site, pr.state, pr.freq, tot.t FROM tot CROSS JOIN pr WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.site = tot.site AND s.state = pr.state)) "
    f"SELECT site, state, {rnd('n / t', 'prob')} FROM s JOIN tot USING (site) UNION ALL SELECT site, state, {rnd('1 / t * freq / sum(freq) OVER (PARTITION BY site)', 'prob')} FROM u",
))
def _(spark, d):
    """State shares per part, one extra count spread over the unobserved flags."""
    cells = t.cells_sup(spark, d)
    orbits = site_orbits(cells, t.FLAGS)
    counts = cells.groupBy("site", "state").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("site").agg((F.sum("n") + 1).alias("t"))
    seen = counts.join(totals, "site").select(F.lit("x").alias("node"), "site", "state", (F.col("n") / F.col("t")).alias("prob"))
    rest = totals.select(F.lit("x").alias("node"), "site", F.lit(None).cast("string").alias("state"), (1 / F.col("t")).alias("prob"))
    comps = t.flag_profiles(spark, d, F.col("l_linenumber"))
    mean = comps.agg(F.array(*[F.struct(F.lit(s).alias("state"), F.avg(F.col("pi")[i]).alias("freq")) for i, s in enumerate(t.FLAGS)])).scalar()
    profiles = totals.select("site", mean.alias("p")).select("site", F.explode("p").alias("p")).select("site", "p.state", "p.freq")
    # a part with all flags has nothing to spread over
    return tidy(lk.expand_zip(seen.unionByName(rest), orbits, profiles).select("site", "state", "prob"))


def _gamma_sql(n: int = 4) -> str:
    """Quantiles by halving, the incomplete gamma function by its series with every term on its own."""
    def lower(a: str, x: str) -> str:
        return f"list_sum(list_transform(range(0, 300), lambda j: exp(({a} + j) * ln({x}) - {x} - lgamma({a} + j + 1))))"

    half = "((lo + hi) / 2)"
    under = f"{lower('alpha', half)} < i / {n}.0"
    return (
        "WITH RECURSIVE d AS (SELECT l_linenumber AS draw, 10 * avg(l_discount) AS alpha FROM lineitem GROUP BY 1), "
        f"s(draw, alpha, i, lo, hi, t) AS (SELECT draw, alpha, unnest(range(1, {n})), 0.0::DOUBLE, 60.0::DOUBLE, 0 FROM d UNION ALL "
        f"SELECT draw, alpha, i, CASE WHEN {under} THEN {half} ELSE lo END, CASE WHEN {under} THEN hi ELSE {half} END, t + 1 FROM s WHERE t < 64), "
        f"e AS (SELECT draw, alpha, i, {lower('(alpha + 1)', half)} AS p FROM s WHERE t = 64 UNION ALL SELECT draw, alpha, unnest([0, {n}]), unnest([0.0, 1.0]) FROM d) "
        f"SELECT draw::BIGINT AS draw, {rnd('alpha', 'alpha', 8)}, i AS cat, {rnd(f'{n} * (next - p)', 'rate', 8)}, {rnd(f'1 / {n}.0', 'w', 8)} "
        "FROM (SELECT *, lead(p) OVER (PARTITION BY draw ORDER BY i) AS next FROM e) WHERE next IS NOT NULL"
    )


@register("gamma_rates", _gamma_sql())
def _(spark, d):
    """Four discrete Gamma rates for the mean discount and tax of every line number, alpha = 10 x mean discount."""
    draws = t.lineitem(spark, d).groupBy(F.col("l_linenumber").alias("draw")).agg((10 * F.avg("l_discount")).alias("alpha"))
    return tidy(gamma_rates(draws, F.col("alpha"), 4), 8)


def _reversible_sql() -> str:
    """Transition matrices as power series of the rate matrix in the recursion ``se``, then pruning level by level."""
    n = range(3)
    pi, q = ("pa", "pn", "pr"), ("qa", "qn", "qr")
    off = {(i, j): f"0.1 * rate * {q[i]} * {q[j]} * {pi[j]}" for i in n for j in n if i != j}
    rates = ", ".join(
        f"{off[i, j] if i != j else ' + '.join(['0'] + [f'-({off[i, k]})' for k in n if k != i])} AS r{i}{j}" for i in n for j in n
    )
    first = ", ".join(f"{float(i == j)}::DOUBLE" for i in n for j in n)
    names = ", ".join(f"m{i}{j}" for i in n for j in n)
    powers = ", ".join(f"({' + '.join(f'm{i}{k} * r{k}{j}' for k in n)}) / (t + 1)" for i in n for j in n)
    sums = ", ".join(f"sum(m{i}{j}) AS t{i}{j}" for i in n for j in n)
    body = (
        ", qt AS (SELECT l_returnflag AS f, avg(l_quantity) / 25 AS q FROM lineitem GROUP BY 1), "
        "qs AS (SELECT max(q) FILTER (f = 'A') AS qa, max(q) FILTER (f = 'N') AS qn, max(q) FILTER (f = 'R') AS qr FROM qt), "
        f"ra AS (SELECT draw, cat, {rates} FROM rate_models CROSS JOIN qs), "
        f"se(draw, cat, t, {names}) AS (SELECT draw, cat, 0, {first} FROM ra UNION ALL SELECT draw, cat, t + 1, {powers} FROM se JOIN ra USING (draw, cat) WHERE t < 40), "
        f"pt AS (SELECT draw, cat, {sums} FROM se GROUP BY 1, 2), {pruning_sql('rate_models', matrix='pt')} {LOGL}"
    )
    return cte(VIEWS, body).replace("WITH ", "WITH RECURSIVE ", 1)


@register("site_loglik_reversible", _reversible_sql())
def _(spark, d):
    """General reversible process: exchangeabilities from mean quantities of the flag pairs."""
    flags = F.array(*[F.lit(s) for s in t.FLAGS])
    mean_qty = t.lineitem(spark, d).groupBy("l_returnflag").agg((F.avg("l_quantity") / 25).alias("q"))
    q = mean_qty.agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "q"))).alias("q")).scalar()
    models = t.rate_models(spark, d).withColumn("_q", q)
    pair = [F.col("_q")[flags[i]] * F.col("_q")[flags[j]] for i, j in ((0, 1), (0, 2), (1, 2))]
    models = models.withColumn("rr", F.array(*pair)).drop("_q")
    return tidy(lk.site_loglik(t.cells_sup(spark, d), t.tree_geo(spark, d), models, t.FLAGS))
