"""Alignment filters, composition and gene queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe import tables as t
from cladeframe.functions import alphabets as ab
from cladeframe.operators import alignment as al
from cladeframe.operators import composition as co
from cladeframe.plans.views_sql import cte, rnd, tidy

QUERIES, SQL = {}, {}
EV = t.EVENT_TYPES


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def n_taxa(cells: DataFrame):
    return cells.select("taxon").distinct().agg(F.count(F.lit(1))).scalar()


def per_taxon(cells: DataFrame) -> DataFrame:
    """Check sums of a cell table: one row per taxon."""
    return cells.groupBy("taxon").agg(
        F.count("state").alias("n_obs"), F.sum(F.when(F.col("state").isNotNull(), F.col("site"))).alias("site_sum"),
        F.max("site").alias("last_site"), F.min("state").alias("min_state"),
    )


CHECK = (
    "SELECT taxon, count(state) AS n_obs, sum(CASE WHEN state IS NOT NULL THEN site END)::BIGINT AS site_sum, "
    "max(site)::BIGINT AS last_site, min(state) AS min_state FROM {0} GROUP BY 1"
)

_MASK = "SELECT site, row_number() OVER (ORDER BY site) - 1 AS new_site FROM (SELECT site FROM cells_5m GROUP BY 1 HAVING count(*) >= 2)"


@register("select_sites", cte("cells_5m", f", m AS ({_MASK}), c AS (SELECT taxon, m.new_site AS site, state FROM cells_5m JOIN m USING (site)) " + CHECK.format("c")))
def _(spark, d):
    """Keep the sites with at least two observed taxa, renumbered."""
    cells = t.cells_5m(spark, d)
    mask = al.site_summary(cells).filter(F.col("n_obs") >= 2)
    return tidy(per_taxon(al.select_sites(cells, mask)))


@register("slice_sites", cte("cells_ev", ", c AS (SELECT taxon, site - 24 AS site, state FROM cells_ev WHERE site >= 24 AND site < 84) " + CHECK.format("c")))
def _(spark, d):
    return tidy(per_taxon(al.slice_sites(t.cells_ev(spark, d), 24, 60, t.n_sites(spark, d, t.SIX_HOURS))))


@register(
    "select_taxa",
    cte("cells_ev", ", c AS (SELECT * FROM cells_ev WHERE taxon IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) " + CHECK.format("c")),
)
def _(spark, d):
    """Users that are customers of one market segment."""
    keep = t.load(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("taxon"))
    return tidy(per_taxon(al.select_taxa(t.cells_ev(spark, d), keep)))


@register("taxon_index", "SELECT c_name AS taxon, row_number() OVER (ORDER BY c_name) - 1 AS taxon_ix FROM customer")
def _(spark, d):
    names = t.load(spark, d, "customer").select(F.col("c_name").alias("taxon"))
    return tidy(al.taxon_index(names))


@register(
    "check_unique_taxa",
    "SELECT count(*) AS n_taxa, sum(c_custkey)::BIGINT AS key_sum FROM customer",
)
def _(spark, d):
    """Names of the wide table are unique; a duplicate would raise."""
    names = t.load(spark, d, "customer").select(F.col("c_custkey").alias("taxon"))
    return tidy(al.check_unique_taxa(names).agg(F.count(F.lit(1)).alias("n_taxa"), F.sum("taxon").alias("key_sum")))


@register("filter_genes_by_missing", cte(
    "cells_ev genes_ev",
    ", fr AS (SELECT gene, site_begin, site_end, 1 - count(state) / ((site_end - site_begin + 1) * (SELECT count(DISTINCT taxon) FROM cells_ev))::DOUBLE AS f "
    "FROM genes_ev LEFT JOIN cells_ev ON site + 1 BETWEEN site_begin AND site_end GROUP BY 1, 2, 3), "
    "k AS (SELECT *, sum(site_end - site_begin + 1) OVER (ORDER BY gene) - (site_end - site_begin + 1) AS off FROM fr WHERE f <= (SELECT avg(f) FROM fr)), "
    "c AS (SELECT taxon, site - (site_begin - 1) + off AS site, state FROM cells_ev JOIN k ON site + 1 BETWEEN site_begin AND site_end) " + CHECK.format("c"),
))
def _(spark, d):
    """Genes whose missing fraction is at most the mean one, concatenated."""
    cells, genes = t.cells_ev(spark, d), t.genes_ev(spark, d)
    fractions = al.gene_missing_fraction(cells, genes, n_taxa(cells))
    limit = fractions.agg(F.avg("missing_frac")).scalar()
    kept = fractions.filter(F.col("missing_frac") <= limit).select("gene", "site_begin", "site_end")
    return tidy(per_taxon(al.concatenate_genes(cells, kept)))


@register("all_missing_sites", cte("cells_5m fine_sites", "SELECT range AS site FROM fine_sites WHERE range NOT IN (SELECT site FROM cells_5m)"))
def _(spark, d):
    return tidy(al.all_missing_sites(t.cells_5m(spark, d), t.n_sites(spark, d, t.FIVE_MINUTES)))


@register("complete_sites", cte(
    "ev",
    "SELECT us // 3600000000 AS site FROM ev GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM ev)",
))
def _(spark, d):
    """Hours in which every event type occurs."""
    hour = F.floor(F.col("us") / 3_600_000_000)
    cells = t.events(spark, d).select(F.col("event_type").alias("taxon"), hour.alias("site"), F.lit("x").alias("state")).distinct()
    return tidy(al.complete_sites(cells, n_taxa(cells)))


_CONST = "SELECT range AS site, count(state) AS n_obs, count(DISTINCT state) AS k FROM fine_sites LEFT JOIN cells_5m ON site = range GROUP BY 1"


@register("constant_sites", cte("cells_5m fine_sites", f"SELECT site, n_obs FROM ({_CONST}) WHERE k <= 1"))
def _(spark, d):
    return tidy(al.constant_sites(t.cells_5m(spark, d), t.n_sites(spark, d, t.FIVE_MINUTES)))


@register("constant_site_counts", cte("cells_5m fine_sites", f"SELECT count(*) FILTER (k = 1) AS eliminated, count(*) FILTER (k = 0) AS all_missing FROM ({_CONST})"))
def _(spark, d):
    return tidy(al.constant_site_counts(t.cells_5m(spark, d), t.n_sites(spark, d, t.FIVE_MINUTES)))


@register("drop_constant_sites", cte(
    "cells_5m",
    ", m AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS new_site FROM (SELECT site FROM cells_5m GROUP BY 1 HAVING count(DISTINCT state) > 1)), "
    "c AS (SELECT taxon, m.new_site AS site, state FROM cells_5m JOIN m USING (site)) " + CHECK.format("c"),
))
def _(spark, d):
    return tidy(per_taxon(al.drop_constant_sites(t.cells_5m(spark, d))))


@register("mask_like", cte(
    "ev cells_ev",
    ", o AS (SELECT DISTINCT user_id AS taxon, us // 21600000000 AS site FROM ev WHERE value >= 50), "
    "c AS (SELECT taxon, site, CASE WHEN o.taxon IS NOT NULL THEN state END AS state FROM cells_ev LEFT JOIN o USING (taxon, site)) " + CHECK.format("c"),
))
def _(spark, d):
    """Missing pattern of the cells that hold an event of value 50 or more."""
    big = t.events(spark, d).filter(F.col("value") >= 50)
    other = big.select(F.col("user_id").alias("taxon"), F.floor(F.col("us") / t.SIX_HOURS).cast("int").alias("site"), F.lit("x").alias("state")).distinct()
    return tidy(per_taxon(al.mask_like(t.cells_ev(spark, d), other)))


@register("activate_sites", cte(
    "cells_ev",
    ", r AS (SELECT site, row_number() OVER (ORDER BY md5('7-' || site)) - 1 AS rk FROM (SELECT DISTINCT site FROM cells_ev)), "
    "c AS (SELECT taxon, site, CASE WHEN rk >= 20 AND rk < 70 THEN state END AS state FROM cells_ev JOIN r USING (site)) " + CHECK.format("c"),
))
def _(spark, d):
    from cladeframe.operators.sampling import site_ranks

    cells = t.cells_ev(spark, d)
    return tidy(per_taxon(al.activate_sites(cells, site_ranks(cells, True, 7), 20, 70)))


@register("encode_states", cte(
    "chars",
    ", c AS (SELECT taxon, site, CASE WHEN upper(ch) IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y') AND ch ~ '^[A-Za-z]$' THEN upper(ch) END AS state FROM chars) "
    "SELECT state, count(*) AS n FROM c GROUP BY 1",
))
def _(spark, d):
    """Document letters read as amino acids; letters outside the protein alphabet count as ambiguity codes."""
    extra = [c for c in "JOUbjouz"]
    dim = ab.alphabet(spark, "protein", missing=ab.PROTEIN_MISSING + extra)
    c = F.col("ch")
    letter = F.when(((c >= "a") & (c <= "z")) | ((c >= "A") & (c <= "Z")), c).otherwise("-")
    raw = t.seqs_doc(spark, d).select("taxon", F.explode("seq").alias("ch")).select("taxon", letter.alias("symbol"))
    return tidy(al.encode_states(raw, dim).groupBy("state").agg(F.count(F.lit(1)).alias("n")))


_GROUPS = "(VALUES ('i','0'),('l','0'),('m','0'),('v','0'),('h','1'),('k','1'),('r','1'),('d','2'),('e','2'),('n','2'),('q','2'),('a','3'),('g','3'),('p','3'),('s','3'),('t','3'),('f','4'),('w','4'),('y','4'),('c','5')) g(state, grp)"


@register("recode", cte("cells_doc", f"SELECT taxon, grp AS state, count(*) AS n FROM cells_doc LEFT JOIN {_GROUPS} USING (state) GROUP BY 1, 2"))
def _(spark, d):
    """Document letters recoded to six amino-acid groups, counted per document."""
    cells = t.cells_doc(spark, d).withColumn("state", F.upper("state"))
    return tidy(al.recode(cells, ab.recoding(spark, "dayhoff6")).groupBy("taxon", "state").agg(F.count(F.lit(1)).alias("n")))


@register("match_taxa_prefix", (
    "WITH n AS (SELECT DISTINCT s_name AS name FROM supplier UNION SELECT DISTINCT p_type FROM part UNION SELECT n_name || '_x' FROM nation), "
    "x AS (SELECT DISTINCT n_name || '_xyz' AS taxon FROM nation UNION SELECT DISTINCT p_type || '!' FROM part) "
    "SELECT name, taxon FROM n LEFT JOIN x ON starts_with(taxon, name) OR starts_with(name, taxon)"
))
def _(spark, d):
    """Supplier names, part types and nation names against longer taxon names."""
    supplier, part, nation = (t.load(spark, d, n) for n in ("supplier", "part", "nation"))
    names = supplier.select(F.col("s_name").alias("name")).union(part.select("p_type")).union(nation.select(F.concat("n_name", F.lit("_x"))))
    taxa = nation.select(F.concat("n_name", F.lit("_xyz")).alias("taxon")).union(part.select(F.concat("p_type", F.lit("!"))))
    return tidy(al.match_taxa_prefix(names, taxa))


@register("assign_genes", cte("cells_ev genes_ev", "SELECT gene, count(*) AS n, sum(site)::BIGINT AS site_sum FROM cells_ev JOIN genes_ev ON site + 1 BETWEEN site_begin AND site_end GROUP BY 1"))
def _(spark, d):
    return tidy(al.assign_genes(t.cells_ev(spark, d), t.genes_ev(spark, d)).groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("site").alias("site_sum")))


@register("gene_missing_fraction", cte(
    "cells_ev genes_ev",
    f"SELECT gene, site_begin, site_end, {rnd('1 - count(state) / ((site_end - site_begin + 1) * (SELECT count(DISTINCT taxon) FROM cells_ev))::DOUBLE', 'missing_frac')} "
    "FROM genes_ev LEFT JOIN cells_ev ON site + 1 BETWEEN site_begin AND site_end GROUP BY 1, 2, 3",
))
def _(spark, d):
    cells = t.cells_ev(spark, d)
    return tidy(al.gene_missing_fraction(cells, t.genes_ev(spark, d), n_taxa(cells)))


@register("empirical_freq", cte("cells_doc", f"SELECT state, count(*) AS n, {rnd('count(*) / sum(count(*)) OVER ()', 'freq', 8)} FROM cells_doc WHERE state IS NOT NULL GROUP BY 1"))
def _(spark, d):
    return tidy(co.empirical_freq(t.cells_doc(spark, d), t.LETTERS), 8)


@register("empirical_freq_pseudocount", cte("cells_ev", f"SELECT state, count(*) AS n, {rnd('count(*) / (5 + sum(count(*)) OVER ())', 'freq', 8)} FROM cells_ev GROUP BY 1"))
def _(spark, d):
    return tidy(co.empirical_freq(t.cells_ev(spark, d), EV, pseudocount_denominator=True), 8)


@register("site_freq", cte("cells_ev", f"SELECT site, state, {rnd('count(*) / sum(count(*)) OVER (PARTITION BY site)', 'freq')} FROM cells_ev GROUP BY 1, 2"))
def _(spark, d):
    return tidy(co.site_freq(t.cells_ev(spark, d)))


_SITE_F = "SELECT site, state, count(*) / sum(count(*)) OVER (PARTITION BY site) AS f FROM {0} WHERE state IS NOT NULL GROUP BY 1, 2"


@register("mean_diversity", cte("cells_doc", f"SELECT {rnd('avg(k)', 'mean_diversity')} FROM (SELECT site, count(DISTINCT state) AS k FROM cells_doc WHERE state IS NOT NULL GROUP BY 1)"))
def _(spark, d):
    return tidy(co.mean_diversity(t.cells_doc(spark, d), t.LETTERS))


@register("mean_squared_freq", cte("cells_doc", f"SELECT {rnd('avg(q)', 'mean_squared_freq')} FROM (SELECT site, sum(f * f) AS q FROM ({_SITE_F.format('cells_doc')}) GROUP BY 1)"))
def _(spark, d):
    return tidy(co.mean_squared_freq(t.cells_doc(spark, d), t.LETTERS))


@register("mean_freq_variance", cte(
    "cells_ev",
    f", f AS ({_SITE_F.format('cells_ev')}), n AS (SELECT count(DISTINCT site) AS n FROM f) "
    f"SELECT {rnd('sum(m2 / n - (m1 / n) ^ 2) / 5', 'mean_freq_variance', 8)} FROM (SELECT state, sum(f) AS m1, sum(f * f) AS m2 FROM f GROUP BY 1), n",
))
def _(spark, d):
    return tidy(co.mean_freq_variance(t.cells_ev(spark, d), EV), 8)


def hetero_sql(source: str, pooled: bool = False, k: str = "(SELECT DISTINCT state FROM c0)") -> str:
    """Per taxon distance from the global composition of ``source`` (taxon, state)."""
    centre = (
        "SELECT state, count(*) / sum(count(*)) OVER () AS g FROM c0 GROUP BY 1" if pooled
        else "SELECT state, sum(f) / (SELECT count(DISTINCT taxon) FROM c0) AS g FROM f GROUP BY 1"
    )
    return (
        f", c0 AS ({source}), f AS (SELECT taxon, state, count(*) / sum(count(*)) OVER (PARTITION BY taxon) AS f FROM c0 GROUP BY 1, 2), "
        f"g AS ({centre}), dist AS (SELECT x.taxon, sum((coalesce(f.f, 0) - g.g) ^ 2) AS dist FROM (SELECT DISTINCT taxon FROM c0) x "
        "CROSS JOIN g LEFT JOIN f ON f.taxon = x.taxon AND f.state = g.state GROUP BY 1) "
    )


@register("composition_heterogeneity", cte("cells_ev", hetero_sql("SELECT taxon, state FROM cells_ev") + f"SELECT taxon, {rnd('dist', 'dist', 8)} FROM dist"))
def _(spark, d):
    return tidy(co.composition_heterogeneity(t.cells_ev(spark, d), EV), 8)


@register("composition_heterogeneity_doc", cte(
    "cells_doc", hetero_sql("SELECT taxon, state FROM cells_doc WHERE state IS NOT NULL") + f"SELECT taxon, {rnd('dist', 'dist', 8)} FROM dist"
))
def _(spark, d):
    """Letter composition of whole documents."""
    return tidy(co.composition_heterogeneity(t.cells_doc(spark, d), t.LETTERS), 8)


@register("heterogeneity_summary", cte(
    "cells_ev", hetero_sql("SELECT taxon, state FROM cells_ev") + f"SELECT {rnd('max(dist)', 'max_dist', 8)}, {rnd('avg(dist)', 'mean_dist', 8)} FROM dist"
))
def _(spark, d):
    return tidy(co.heterogeneity_summary(co.composition_heterogeneity(t.cells_ev(spark, d), EV)), 8)


@register("site_orbits", cte(
    "cells_5m",
    "SELECT site, string_agg(DISTINCT state, '|' ORDER BY state) AS orbit, count(DISTINCT state) AS orbit_size, least(count(DISTINCT state) + 1, 5) AS zip_size FROM cells_5m GROUP BY 1",
))
def _(spark, d):
    return tidy(co.site_orbits(t.cells_5m(spark, d), EV).withColumn("orbit", F.array_join("orbit", "|")))


@register("zip_cells", cte(
    "cells_5m",
    ", o AS (SELECT site, state, row_number() OVER (PARTITION BY site ORDER BY state) - 1 AS code FROM (SELECT DISTINCT site, state FROM cells_5m)) "
    "SELECT state, code, count(*) AS n FROM cells_5m JOIN o USING (site, state) GROUP BY 1, 2",
))
def _(spark, d):
    cells = t.cells_5m(spark, d)
    coded = co.zip_cells(cells, co.site_orbits(cells, EV))
    return tidy(coded.groupBy("state", "code").agg(F.count(F.lit(1)).alias("n")))


@register("orbit_summary", cte(
    "cells_5m fine_sites",
    f"SELECT {rnd('avg(k)', 'mean_orbit')}, {rnd('avg((least(k + 1, 5) / 5.0) ^ 2)', 'speed_factor')}, count(*) FILTER (k = 1) AS n_constant "
    "FROM (SELECT range AS site, count(DISTINCT state) AS k FROM fine_sites LEFT JOIN cells_5m ON site = range GROUP BY 1)",
))
def _(spark, d):
    return tidy(co.orbit_summary(co.site_orbits(t.cells_5m(spark, d), EV), 5, t.n_sites(spark, d, t.FIVE_MINUTES)))


@register("render_state")
def _(spark, d):
    """Rows of the alignment as text: first letter of the state, '-' where missing."""
    from cladeframe.sources.writers import alignment_lines

    cells = t.cells_ev(spark, d).withColumn("state", F.substring("state", 1, 1))
    return alignment_lines(cells, t.n_sites(spark, d, t.SIX_HOURS))


SQL["render_state"] = cte(
    "cells_ev ev_sites",
    ", u AS (SELECT DISTINCT taxon FROM cells_ev), g AS (SELECT taxon, range AS site FROM u CROSS JOIN ev_sites) "
    "SELECT g.taxon, string_agg(coalesce(substr(c.state, 1, 1), '-'), '' ORDER BY g.site) AS seq FROM g LEFT JOIN cells_ev c ON c.taxon = g.taxon AND c.site = g.site GROUP BY 1",
)
