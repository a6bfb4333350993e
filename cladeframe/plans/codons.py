"""Codon queries over whole documents read as nucleotides."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe import tables as t
from cladeframe.functions import alphabets as ab
from cladeframe.operators import codon as cd
from cladeframe.operators import composition as co
from cladeframe.plans.alignments import hetero_sql
from cladeframe.plans.views_sql import cte, rnd, tidy

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def doc_codons(spark, d):
    return cd.codons_of_text(t.nuc_text(spark, d))


CODON_COUNTS = cte("codon_cells", "SELECT state, count(*) AS n FROM codon_cells GROUP BY 1")


@register("codons", CODON_COUNTS)
def _(spark, d):
    """Codon counts by regrouping nucleotide cells."""
    return tidy(cd.codons(t.nuc_cells(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n")))


@register("codons_of_rows", CODON_COUNTS)
def _(spark, d):
    """Codon counts cut inside the wide rows."""
    return tidy(cd.codons_of_rows(t.nuc_seqs(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n")))


@register("codons_of_text", CODON_COUNTS)
def _(spark, d):
    """Codon counts cut from text."""
    return tidy(doc_codons(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n")))


@register("translate", cte("codon_cells", "SELECT taxon, aa AS state, count(*) AS n FROM codon_cells GROUP BY 1, 2"))
def _(spark, d):
    return tidy(cd.translate(doc_codons(spark, d)).groupBy("taxon", "state").agg(F.count(F.lit(1)).alias("n")))


@register("is_stop", cte("codon_cells", "SELECT taxon, count(*) FILTER (stop) AS n_stops FROM codon_cells GROUP BY 1"))
def _(spark, d):
    """Stop codons per document."""
    p1, p2, p3 = (F.substring("triple", i, 1) for i in (1, 2, 3))
    return tidy(doc_codons(spark, d).groupBy("taxon").agg(F.count(F.when(ab.is_stop(p1, p2, p3), 1)).alias("n_stops")))


@register("drop_aa_constant_sites", cte(
    "codon_cells",
    ", m AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS new_site FROM (SELECT site FROM codon_cells GROUP BY 1 HAVING count(DISTINCT aa) > 1)) "
    "SELECT taxon, count(state) AS n_obs, max(m.new_site) AS last_site FROM codon_cells JOIN m USING (site) GROUP BY 1",
))
def _(spark, d):
    kept = cd.drop_aa_constant_sites(doc_codons(spark, d))
    return tidy(kept.groupBy("taxon").agg(F.count("state").alias("n_obs"), F.max("site").alias("last_site")))


@register("aa_constant_site_counts", cte(
    "codon_cells",
    "SELECT count(*) FILTER (k = 1) AS eliminated, count(*) FILTER (k = 0) AS all_missing, count(*) FILTER (k > 1) AS kept "
    "FROM (SELECT site, count(DISTINCT aa) AS k FROM codon_cells GROUP BY 1)",
))
def _(spark, d):
    return tidy(cd.aa_constant_site_counts(doc_codons(spark, d)))


def _bases(places: str) -> str:
    parts = [f"SELECT taxon, p{p} AS state FROM codon_cells WHERE state IS NOT NULL" for p in places]
    return " UNION ALL ".join(parts)


for _name, _places, _pos in (("nuc_heterogeneity", "123", None), ("nuc_heterogeneity_pos3", "3", 3)):
    def _fn(spark, d, pos=_pos):
        return tidy(cd.nuc_heterogeneity(doc_codons(spark, d), pos), 8)

    register(_name, cte("codon_cells", hetero_sql(_bases(_places), pooled=True) + f"SELECT taxon, {rnd('dist', 'dist', 8)} FROM dist"))(_fn)


@register("nuc123_heterogeneity", cte(
    "codon_cells",
    f", a AS (SELECT taxon, state, count(*) / sum(count(*)) OVER (PARTITION BY taxon) AS f FROM ({_bases('12')}) GROUP BY 1, 2), "
    f"b AS (SELECT taxon, state, count(*) / sum(count(*)) OVER (PARTITION BY taxon) AS f FROM ({_bases('3')}) GROUP BY 1, 2) "
    f"SELECT taxon, {rnd('sum((coalesce(a.f, 0) - coalesce(b.f, 0)) ^ 2)', 'dist', 8)} FROM a FULL JOIN b USING (taxon, state) GROUP BY 1",
))
def _(spark, d):
    return tidy(cd.nuc123_heterogeneity(doc_codons(spark, d)), 8)


@register("aa_heterogeneity", cte(
    "codon_cells", hetero_sql("SELECT taxon, aa AS state FROM codon_cells WHERE aa IS NOT NULL", pooled=True) + f"SELECT {rnd('max(dist)', 'max_dist', 8)}, {rnd('avg(dist)', 'mean_dist', 8)} FROM dist"
))
def _(spark, d):
    return tidy(co.heterogeneity_summary(cd.aa_heterogeneity(doc_codons(spark, d), ab.PROTEIN)), 8)


@register("codon_diversity", cte("codon_cells", "SELECT sum(k)::BIGINT AS diversity FROM (SELECT site, count(DISTINCT aa) AS k FROM codon_cells GROUP BY 1)"))
def _(spark, d):
    return tidy(cd.codon_diversity(doc_codons(spark, d), ab.PROTEIN))


@register("codon_neighbours", cte(
    "codon_cells neighbours",
    "SELECT codon_from, pos, sum(n * synonymous::INT)::BIGINT AS n_syn, sum(n * (1 - synonymous::INT))::BIGINT AS n_nonsyn "
    "FROM neighbours JOIN (SELECT state, count(*) AS n FROM codon_cells GROUP BY 1) ON state = codon_from GROUP BY 1, 2",
))
def _(spark, d):
    """Single-step changes open to the codons of the documents, by position and kind."""
    seen = doc_codons(spark, d).groupBy(F.col("state").alias("codon_from")).agg(F.count(F.lit(1)).alias("n"))
    steps = seen.join(F.broadcast(cd.codon_neighbours(ab.genetic_code(spark))), "codon_from")
    syn = F.col("synonymous").cast("int")
    return tidy(steps.groupBy("codon_from", "pos").agg(F.sum(F.col("n") * syn).alias("n_syn"), F.sum(F.col("n") * (1 - syn)).alias("n_nonsyn")))


@register("degeneracy", cte(
    "codon_cells code",
    ", g AS (SELECT p1, p2, aa, count(*) AS degeneracy FROM code WHERE NOT is_stop GROUP BY 1, 2, 3) "
    "SELECT taxon, degeneracy, count(*) AS n FROM codon_cells c JOIN g ON c.p1 = g.p1 AND c.p2 = g.p2 AND c.aa = g.aa GROUP BY 1, 2",
))
def _(spark, d):
    """Codons per document and degeneracy class."""
    table = F.broadcast(cd.degeneracy(ab.genetic_code(spark)).withColumnRenamed("codon", "state"))
    return tidy(doc_codons(spark, d).join(table, "state").groupBy("taxon", "degeneracy").agg(F.count(F.lit(1)).alias("n")))


@register("non_ct_nearest", cte(
    "codon_cells neighbours",
    ", q AS (SELECT aa_from, aa_to, CASE WHEN bool_or(nuc_from || nuc_to IN ('CT', 'TC')) THEN 0 ELSE 1 END AS v FROM neighbours WHERE NOT synonymous GROUP BY 1, 2), "
    "n AS (SELECT aa, count(*) AS n FROM codon_cells WHERE aa IS NOT NULL GROUP BY 1), acids AS (SELECT DISTINCT aa FROM code WHERE aa IS NOT NULL) "
    "SELECT n.aa AS aa_from, coalesce(q.v, -1)::BIGINT AS non_ct, count(*) AS n_acids, any_value(n.n) AS n FROM n JOIN acids b ON b.aa <> n.aa "
    "LEFT JOIN q ON q.aa_from = n.aa AND q.aa_to = b.aa GROUP BY 1, 2",
))
def _(spark, d):
    """Kinds of the nearest codon steps open to the acids of the documents."""
    seen = cd.translate(doc_codons(spark, d)).groupBy(F.col("state").alias("aa_from")).agg(F.count(F.lit(1)).alias("n"))
    pairs = cd.non_ct_nearest(ab.genetic_code(spark))
    return tidy(pairs.join(seen, "aa_from").groupBy("aa_from", "non_ct").agg(F.count(F.lit(1)).alias("n_acids"), F.first("n").alias("n")))
