"""Substitution-mapping and mutation-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe import tables as t
from cladeframe.functions.alphabets import genetic_code, pair_index
from cladeframe.operators import codon as cd
from cladeframe.operators import mapping as mp
from cladeframe.operators import mutsel as ms
from cladeframe.plans.views_sql import cte, rnd, tidy

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def steps(spark, d):
    return mp.path_steps(t.paths_ev(spark, d), t.path_hour())


@register("path_steps", cte("paths_ev", "SELECT run, iter, state, next_state, count(*) AS n FROM paths_ev GROUP BY 1, 2, 3, 4"))
def _(spark, d):
    """Successive states of the event paths."""
    return tidy(steps(spark, d).groupBy("run", "iter", "state", "next_state").agg(F.count(F.lit(1)).alias("n")))


_SUBS = "SELECT run, iter, branch, site, count(*) - 1 AS n_sub FROM paths_ev GROUP BY 1, 2, 3, 4"
_RATES = "SELECT user_id AS site, avg(value) / 50 AS rate FROM events GROUP BY 1"
_LENGTHS = "SELECT us // 86400000000 AS branch, avg(value) / 50 AS length FROM ev GROUP BY 1"


def rates(spark, d):
    return t.events(spark, d).groupBy(F.col("user_id").alias("site")).agg((F.avg("value") / 50).alias("rate"))


def lengths(spark, d):
    return t.events(spark, d).groupBy(F.floor(F.col("us") / t.DAY).alias("branch")).agg((F.avg("value") / 50).alias("length"))


@register("branch_suffstats", cte(
    "paths_ev", f", c AS ({_SUBS}), r AS ({_RATES}) SELECT run, iter, branch, sum(n_sub)::BIGINT AS n_sub, {rnd('sum(rate)', 'exposure')} FROM c JOIN r USING (site) WHERE n_sub > 0 GROUP BY 1, 2, 3"
))
def _(spark, d):
    """Substitutions and exposure per day; days with a single event of a user are not informative."""
    counts = mp.substitution_counts(t.paths_ev(spark, d))
    return tidy(mp.branch_suffstats(counts.filter(F.col("n_sub") > 0), rates(spark, d)))


@register("site_rate_suffstats", cte(
    "paths_ev", f", c AS ({_SUBS}), l AS ({_LENGTHS}) SELECT run, iter, site, sum(n_sub)::BIGINT AS n_sub, {rnd('sum(length)', 'exposure')} FROM c JOIN l USING (branch) GROUP BY 1, 2, 3"
))
def _(spark, d):
    return tidy(mp.site_rate_suffstats(mp.substitution_counts(t.paths_ev(spark, d)), lengths(spark, d)))


_ROOT = "SELECT run, iter, site, arg_min(state, branch * 86400000000 + seq_no) AS state FROM paths_ev GROUP BY 1, 2, 3"
_PROFILE = f"SELECT run, iter, site, state, count(*) AS n FROM ({_ROOT} UNION ALL SELECT run, iter, site, next_state FROM paths_ev WHERE next_state IS NOT NULL) GROUP BY 1, 2, 3, 4"


def profile_counts(spark, d):
    paths = t.paths_ev(spark, d)
    root = paths.groupBy("run", "iter", "site").agg(F.min(F.struct("branch", "seq_no", "state")).alias("f")).select("run", "iter", "site", "f.state")
    return mp.site_profile_suffstats(mp.path_steps(paths, t.path_hour()), root)


@register("site_profile_suffstats", cte("paths_ev", _PROFILE))
def _(spark, d):
    return tidy(profile_counts(spark, d))


@register("mean_site_profile_suffstats", cte(
    "paths_ev", f", p AS ({_PROFILE}) SELECT site, state, {rnd('sum(n) / (SELECT count(*) FROM (SELECT DISTINCT run, iter FROM p))', 'mean_n')} FROM p GROUP BY 1, 2"
))
def _(spark, d):
    counts = profile_counts(spark, d)
    n_draws = counts.select("run", "iter").distinct().count()
    return tidy(mp.mean_site_profile_suffstats(counts, n_draws))


def _index(a: str) -> str:
    return f"list_position(['click', 'error', 'purchase', 'signup', 'view'], {a}) - 1"


@register("path_suffstats_pairs", cte(
    "paths_ev",
    f", x AS (SELECT run, iter, site, state AS s_from, next_state AS s_to, count(*) AS n, least({_index('state')}, {_index('next_state')}) AS i, greatest({_index('state')}, {_index('next_state')}) AS j "
    "FROM paths_ev WHERE next_state IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 7, 8) "
    "SELECT run, iter, site, s_from, s_to, n, CASE WHEN i <> j THEN ((9 - i) * i // 2 + j - i - 1)::BIGINT END AS pair FROM x",
))
def _(spark, d):
    """Pair counts per user with the index of the unordered pair."""
    pairs, _ = mp.path_suffstats(steps(spark, d))
    names = F.array(*[F.lit(s) for s in t.EVENT_TYPES])
    i, j = F.array_position(names, F.col("s_from")) - 1, F.array_position(names, F.col("s_to")) - 1
    return tidy(pairs.withColumn("pair", F.when(i != j, pair_index(i, j, 5))))


@register("path_suffstats_waits", cte(
    "paths_ev", f", l AS ({_LENGTHS}), r AS ({_RATES}) SELECT run, iter, site, state, {rnd('sum(rel_time * length * rate)', 'time')} FROM paths_ev JOIN l USING (branch) JOIN r USING (site) GROUP BY 1, 2, 3, 4"
))
def _(spark, d):
    """Waiting times per user and state, scaled by rate times branch length."""
    moved = steps(spark, d).join(lengths(spark, d), "branch").join(rates(spark, d), "site")
    scaled = moved.withColumn("rel_time", F.col("rel_time") * F.col("length") * F.col("rate")).drop("length", "rate")
    return tidy(mp.path_suffstats(scaled)[1])


@register("path_suffstat_maps", cte(
    "paths_ev",
    ", x AS (SELECT run, iter, site, state || '>' || next_state AS k, count(*) AS n FROM paths_ev WHERE next_state IS NOT NULL GROUP BY 1, 2, 3, 4) "
    "SELECT run, iter, site, string_agg(k || '=' || n, ',' ORDER BY k) AS pair_counts FROM x GROUP BY 1, 2, 3",
))
def _(spark, d):
    """Pair counts of each user as one map, shown as text."""
    pairs, _ = mp.path_suffstats(steps(spark, d))
    maps = mp.path_suffstat_maps(pairs)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("pair_counts")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return tidy(maps.withColumn("pair_counts", text))


@register("path_rate_suffstats", cte(
    "paths_ev",
    ", q AS (SELECT event_type AS state, count(*) / (SELECT count(*) FROM events)::DOUBLE - 1 AS q FROM events GROUP BY 1) "
    f"SELECT run, iter, site, count(next_state) AS n_sub, {rnd('-sum(rel_time * 0.7 * q)', 'beta')} FROM paths_ev JOIN q USING (state) GROUP BY 1, 2, 3",
))
def _(spark, d):
    """Exposure under the equal-rates matrix of the event shares."""
    ev = t.load(spark, d, "events")
    total = ev.agg(F.count(F.lit(1))).scalar()
    diagonal = ev.groupBy(F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("n")).select("state", (F.col("n") / total - 1).alias("q"))
    return tidy(mp.path_rate_suffstats(steps(spark, d), diagonal, 0.7))


@register("rr_suffstats", cte(
    "paths_ev",
    ", p AS (SELECT user_id AS site, event_type AS state, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS freq FROM events GROUP BY 1, 2), "
    "w AS (SELECT run, iter, site, state, sum(rel_time) AS time FROM paths_ev GROUP BY 1, 2, 3, 4), "
    "e AS (SELECT run, iter, least(w.state, p.state) AS s1, greatest(w.state, p.state) AS s2, sum(time * freq) AS beta FROM w JOIN p ON w.site = p.site AND w.state <> p.state GROUP BY 1, 2, 3, 4), "
    "c AS (SELECT run, iter, least(state, next_state) AS s1, greatest(state, next_state) AS s2, count(*) AS n FROM paths_ev WHERE state <> next_state GROUP BY 1, 2, 3, 4) "
    f"SELECT run, iter, s1, s2, {rnd('beta', 'beta')}, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (run, iter, s1, s2)",
))
def _(spark, d):
    """Exchangeability statistics with each user's event shares as profile."""
    from cladeframe.operators.composition import site_freq

    pairs, waits = mp.path_suffstats(steps(spark, d))
    shares = site_freq(t.load(spark, d, "events").select(F.col("user_id").alias("site"), F.col("event_type").alias("state")))
    return tidy(mp.rr_suffstats(pairs, waits, shares))


@register("component_suffstats", cte(
    "paths_ev", f", p AS ({_PROFILE}) SELECT run, iter, site % 10 AS comp, state, sum(n)::BIGINT AS n FROM p GROUP BY 1, 2, 3, 4"
))
def _(spark, d):
    """Site counts summed over ten groups of users."""
    counts = profile_counts(spark, d)
    alloc = counts.select("run", "iter", "site").distinct().withColumn("comp", F.col("site") % 10)
    return tidy(mp.component_suffstats(counts, alloc))


@register("rate_category_suffstats", cte(
    "paths_ev",
    f", c AS ({_SUBS}), l AS ({_LENGTHS}), s AS (SELECT run, iter, site, sum(n_sub)::BIGINT AS n_sub, sum(length) AS exposure FROM c JOIN l USING (branch) GROUP BY 1, 2, 3) "
    f"SELECT run, iter, site % 4 AS cat, sum(n_sub)::BIGINT AS n_sub, {rnd('sum(exposure)', 'exposure')} FROM s GROUP BY 1, 2, 3",
))
def _(spark, d):
    stats = mp.site_rate_suffstats(mp.substitution_counts(t.paths_ev(spark, d)), lengths(spark, d))
    alloc = t.load(spark, d, "events").select(F.col("user_id").alias("site")).distinct().withColumn("cat", F.col("site") % 4)
    return tidy(mp.rate_category_suffstats(stats, alloc))


_PER_SITE = f"SELECT run, iter AS draw, sum(n_sub) / count(DISTINCT site)::DOUBLE AS per_site FROM ({_SUBS}) GROUP BY 1, 2"


@register("mapping_diff", cte(
    "paths_ev",
    f", x AS ({_PER_SITE}), y AS (SELECT o.per_site AS o, p.per_site AS p FROM x o JOIN x p USING (draw) WHERE o.run = 'obs' AND p.run = 'pred') "
    f"SELECT {rnd('avg(o)', 'mean_obs')}, {rnd('avg(p)', 'mean_pred')}, {rnd('avg(o - p)', 'mean_diff')}, {rnd('stddev_pop(o - p)', 'sd_diff')} FROM y",
))
def _(spark, d):
    """Even against odd events as observed and predicted mappings, weeks as draws."""
    counts = mp.substitution_counts(t.paths_ev(spark, d)).groupBy("run", F.col("iter").alias("draw"), "site").agg(F.sum("n_sub").alias("n"))
    per = counts.groupBy("run", "draw").agg((F.sum("n") / F.count(F.lit(1))).alias("per_site"))
    return tidy(mp.mapping_diff(per.filter(F.col("run") == "obs"), per.filter(F.col("run") == "pred")))


def _nonsyn(filtered: bool) -> str:
    cond = "AND (state IN ('click', 'view')) <> (next_state IN ('click', 'view'))" if filtered else ""
    return cte(
        "paths_ev",
        f", x AS (SELECT run, iter, count(*) FILTER (next_state IS NOT NULL {cond}) AS n FROM paths_ev GROUP BY 1, 2), "
        "y AS (SELECT o.n AS o, p.n AS p FROM x o JOIN x p USING (iter) WHERE o.run = 'obs' AND p.run = 'pred') "
        f"SELECT count(*) AS n_draws, {rnd('avg(o)', 'mean_obs')}, {rnd('avg(p)', 'mean_pred')}, {rnd('avg((p > o)::INT)', 'pvalue')} FROM y",
    )


def nonsyn(spark, d, all_pairs):
    counts = steps(spark, d).filter(F.col("next_state").isNotNull()).groupBy("run", F.col("iter").alias("draw"), F.col("state").alias("s_from"), F.col("next_state").alias("s_to")).agg(F.count(F.lit(1)).alias("n"))
    kind = None
    if not all_pairs:
        kind = spark.createDataFrame([(s, "x" if s in ("click", "view") else "y") for s in t.EVENT_TYPES], "state string, aa string")
    both = [mp.nonsyn_counts(counts.filter(F.col("run") == r), kind) for r in ("obs", "pred")]
    return tidy(mp.nonsyn_test(*both))


@register("nonsyn_test", _nonsyn(True))
def _(spark, d):
    """Changes between reading and acting events as the nonsynonymous ones."""
    return nonsyn(spark, d, False)


@register("nonsyn_test_all_pairs", _nonsyn(False))
def _(spark, d):
    return nonsyn(spark, d, True)


def fluxes(spark, d):
    m = t.mutsel(spark, d)
    codes = genetic_code(spark)
    return ms.codon_fluxes(codes, cd.codon_neighbours(codes), m["nuc_stat"], m["nuc_rr"], m["codon_profile"], m["aa_profile"], m["omega"]), m


MS = "hist ms_alloc"
_COLS = ms.FLUXES


@register("codon_stationary", cte("stationary", f"SELECT 'li' AS run, iter, comp, codon, {rnd('prob', 'prob', 8)} FROM stationary"))
def _(spark, d):
    m = t.mutsel(spark, d)
    return tidy(ms.codon_stationary(genetic_code(spark), m["nuc_stat"], m["codon_profile"], m["aa_profile"]), 8)


@register("fixation_rate", cte("fluxes", f"SELECT synonymous, count(*) AS n, {rnd('sum(sub) / sum(mut)', 'mean_fixation')}, {rnd('avg(s)', 'mean_s')} FROM fluxes GROUP BY 1"))
def _(spark, d):
    """Mean relative fixation rate of synonymous and other changes."""
    f, _ = fluxes(spark, d)
    return tidy(f.groupBy("synonymous").agg(F.count(F.lit(1)).alias("n"), (F.sum("sub") / F.sum("mut")).alias("mean_fixation"), F.avg("s").alias("mean_s")))


@register("selection_histograms", cte(
    MS,
    ", sz AS (SELECT iter, comp, count(*) AS n FROM ms_alloc GROUP BY 1, 2), pool AS (SELECT iter, bin, " + ", ".join(f"sum({c} * n) AS {c}" for c in _COLS)
    + " FROM hist JOIN sz USING (iter, comp) GROUP BY 1, 2), nm AS (SELECT bin, " + ", ".join(f"{c} / sum({c}) OVER (PARTITION BY iter) AS {c}" for c in _COLS)
    + " FROM pool) SELECT bin::BIGINT AS bin, " + rnd("any_value(-30 + bin * 0.25)", "centre") + ", " + ", ".join(rnd(f"sum({c}) / (SELECT count(DISTINCT iter) FROM ms_alloc)", c, 8) for c in _COLS) + " FROM nm GROUP BY 1",
))
def _(spark, d):
    f, m = fluxes(spark, d)
    return tidy(ms.selection_histograms(f, m["alloc"]), 8, centre=6)


@register("site_selection_histograms", cte(
    MS,
    ", nm AS (SELECT iter, comp, bin, " + ", ".join(f"{c} / sum({c}) OVER (PARTITION BY iter, comp) AS {c}" for c in _COLS)
    + " FROM hist), k AS (SELECT site, count(*) AS k FROM ms_alloc GROUP BY 1) SELECT site, bin::BIGINT AS bin, " + ", ".join(rnd(f"sum({c}) / any_value(k)", c, 8) for c in _COLS)
    + " FROM ms_alloc JOIN nm USING (iter, comp) JOIN k USING (site) GROUP BY 1, 2",
))
def _(spark, d):
    f, m = fluxes(spark, d)
    return tidy(ms.site_selection_histograms(f, m["alloc"]), 8)


@register("site_dnds", cte(
    MS,
    ", tt AS (SELECT iter, comp, (sum(nonsyn_sub) / sum(syn_sub)) / (sum(nonsyn_mut) / sum(syn_mut)) AS dnds FROM hist GROUP BY 1, 2) "
    f"SELECT site, {rnd('avg(dnds)', 'dnds')}, {rnd('avg((dnds > 1)::INT)', 'p_above_one')} FROM ms_alloc JOIN tt USING (iter, comp) GROUP BY 1",
))
def _(spark, d):
    f, m = fluxes(spark, d)
    return tidy(ms.site_dnds(f, m["alloc"]))


@register("mutsel_means", cte(
    "codon_profile nuc_stat",
    ", x AS (SELECT 'codon' AS kind, codon AS item, freq AS value FROM codon_profile UNION ALL SELECT 'nuc', nuc, freq FROM nuc_stat UNION ALL SELECT 'length', 'tree', v FROM (SELECT avg(l_tax) AS v FROM lineitem GROUP BY l_linenumber)) "
    f"SELECT kind, item, {rnd('avg(value)', 'mean', 8)}, {rnd('stddev_pop(value)', 'sd', 8)} FROM x GROUP BY 1, 2",
))
def _(spark, d):
    m = t.mutsel(spark, d)
    return tidy(ms.mutsel_means(m["codon_profile"], m["nuc_stat"], m["lengths"]), 8)


@register("mutsel_site_aa", cte(
    "aa_profile ms_alloc", f"SELECT site, aa AS state, {rnd('avg(freq)', 'freq', 8)} FROM ms_alloc JOIN aa_profile USING (iter, comp) GROUP BY 1, 2"
))
def _(spark, d):
    """Posterior mean amino-acid profile of every site."""
    from cladeframe.operators.posterior import mean_site_profiles

    m = t.mutsel(spark, d)
    return tidy(mean_site_profiles(m["alloc"], m["aa_profile"].withColumnRenamed("aa", "state")), 8)
