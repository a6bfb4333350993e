"""Replicate sampling queries; the hash order is md5 on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe import tables as t
from cladeframe.operators import sampling as sa
from cladeframe.plans.alignments import CHECK
from cladeframe.plans.views_sql import cte, tidy

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


_CV = (
    ", s AS (SELECT DISTINCT site FROM cells_ev), r AS (SELECT rep, site, row_number() OVER (PARTITION BY rep ORDER BY md5('3-' || rep || '-' || site)) - 1 AS k FROM s CROSS JOIN (SELECT range AS rep FROM range(4))), "
    "cv AS (SELECT rep, site, role, row_number() OVER (PARTITION BY rep, role ORDER BY site) - 1 AS new_site FROM (SELECT rep, site, CASE WHEN k < 60 THEN 'learn' ELSE 'test' END AS role FROM r WHERE k < 90)) "
)


@register("cv_replicates", cte("cells_ev", _CV + "SELECT rep, site, role, new_site FROM cv"))
def _(spark, d):
    """Four replicates of 60 learning and 30 test sites."""
    return tidy(sa.cv_replicates(t.cells_ev(spark, d), 60, 30, 4, 3))


@register("replicate_cells", cte(
    "cells_ev", _CV + "SELECT rep, role, taxon, count(*) AS n_obs, sum(new_site)::BIGINT AS site_sum FROM cells_ev JOIN cv USING (site) GROUP BY 1, 2, 3"
))
def _(spark, d):
    cells = t.cells_ev(spark, d)
    out = sa.replicate_cells(cells, sa.cv_replicates(cells, 60, 30, 4, 3))
    return tidy(out.groupBy("rep", "role", "taxon").agg(F.count("state").alias("n_obs"), F.sum("site").alias("site_sum")))


@register("gene_jackknife", cte(
    "cells_ev genes_ev",
    ", j AS (SELECT rep, gene, site_begin, site_end, row_number() OVER (PARTITION BY rep ORDER BY md5('11-' || rep || '-' || gene)) AS k FROM genes_ev CROSS JOIN (SELECT range AS rep FROM range(5)) WHERE gene <> 2), "
    "o AS (SELECT *, 10 * (row_number() OVER (PARTITION BY rep ORDER BY gene) - 1) AS off FROM j WHERE k <= 6), "
    "c AS (SELECT rep, taxon, site - (site_begin - 1) + off AS site, state FROM cells_ev JOIN o ON site + 1 BETWEEN site_begin AND site_end) "
    + CHECK.format("c").replace("SELECT taxon", "SELECT rep, taxon").replace("GROUP BY 1", "GROUP BY 1, 2"),
))
def _(spark, d):
    """Five replicates of six genes, gene 2 excluded, concatenated in order."""
    exclude = t.genes_ev(spark, d).filter(F.col("gene") == 2)
    out = sa.gene_jackknife(t.cells_ev(spark, d), t.genes_ev(spark, d), 6, 5, 11, exclude)
    return tidy(out.groupBy("rep", "taxon").agg(
        F.count("state").alias("n_obs"), F.sum(F.when(F.col("state").isNotNull(), F.col("site"))).alias("site_sum"),
        F.max("site").alias("last_site"), F.min("state").alias("min_state"),
    ))


@register("site_ranks", cte(
    "cells_5m",
    ", s AS (SELECT DISTINCT site FROM cells_5m) SELECT site, row_number() OVER (ORDER BY md5('7-' || site)) - 1 AS site_rank, row_number() OVER (ORDER BY site) - 1 AS own_rank FROM s",
))
def _(spark, d):
    """Random permutation beside the identity ranks."""
    cells = t.cells_5m(spark, d)
    return tidy(sa.site_ranks(cells, True, 7).join(sa.site_ranks(cells, False).withColumnRenamed("site_rank", "own_rank"), "site"))
