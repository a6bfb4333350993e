"""SQL twins of the views in ``cladeframe.tables`` and the output conventions of the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.functions.alphabets import codon_rows

MICROS = "epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')"


def nudge(digits: int) -> float:
    """Moves exact ties, where two summation orders round apart, off the rounding boundary."""
    return 1.37 * 10.0 ** -(digits + 3)


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Output form of a query: doubles rounded (``special`` digits by column), integers as BIGINT."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            k = special.get(f.name, digits)
            c = F.round(c.cast("double") + F.lit(nudge(k)), k) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType | T.DecimalType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def rnd(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr}) + {nudge(digits):.4e}, {digits}) + 0.0 AS {name}"


def cte(names: str, query: str) -> str:
    """Put the named views, and those they need, in front of a query.

    A query with views of its own begins with ``, name AS (...)``.
    """
    order: list[str] = []

    def need(n: str) -> None:
        deps, _ = VIEWS[n]
        for d in deps.split():
            need(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + query


def _code_values(code: str) -> str:
    rows = [
        f"('{c}','{a}','{b}','{d}',{'NULL' if stop else repr(aa)},{str(stop).lower()})"
        for _, c, a, b, d, aa, stop in codon_rows(code)
    ]
    return f"SELECT * FROM (VALUES {','.join(rows)}) t(codon, p1, p2, p3, aa, is_stop)"


_FLAG = "sum(CASE WHEN l_returnflag = '{0}' THEN 1 ELSE 0 END)"
_A, _N, _R = (_FLAG.format(s) for s in "ANR")
_PI = f"{_A} / count(*)::DOUBLE AS pa, {_N} / count(*)::DOUBLE AS pn, {_R} / count(*)::DOUBLE AS pr"


def _smoothed(keys: str, slot: str, names: list[str], name: str) -> str:
    """Counts plus one over the total, for every key and every name."""
    values = ",".join(f"({i},'{v}')" for i, v in enumerate(names))
    keylist = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"c.{k} = k.{k}" for k in keylist)
    return (
        f"SELECT {', '.join('k.' + k for k in keylist)}, v.nm AS {name}, (coalesce(c.n, 0) + 1) / (k.t + {len(names)})::DOUBLE AS freq "
        f"FROM (SELECT {keys}, count(*) AS t FROM li7 GROUP BY {keys}) k CROSS JOIN (VALUES {values}) v(ix, nm) "
        f"LEFT JOIN (SELECT {keys}, ({slot})::INT AS s, count(*) AS n FROM li7 GROUP BY ALL) c ON {on} AND c.s = v.ix"
    )


_SENSE = [r[1] for r in codon_rows("universal") if not r[6]]

# name: (views it needs, text)
VIEWS: dict[str, tuple[str, str]] = {
    "ev": ("", f"SELECT *, {MICROS} AS us FROM events"),
    "cells_ev": ("ev", "SELECT user_id AS taxon, us // 21600000000 AS site, arg_max(event_type, ts) AS state FROM ev GROUP BY 1, 2"),
    "cells_5m": ("ev", "SELECT user_id AS taxon, us // 300000000 AS site, arg_max(event_type, ts) AS state FROM ev GROUP BY 1, 2"),
    "cells_rep": ("ev", "SELECT event_id % 10 AS rep, user_id AS taxon, us // 21600000000 AS site, arg_max(event_type, ts) AS state FROM ev GROUP BY 1, 2, 3"),
    "ev_sites": ("ev", "SELECT unnest(range((SELECT max(us) // 21600000000 + 1 FROM ev))) AS range"),
    "fine_sites": ("ev", "SELECT unnest(range((SELECT max(us) // 300000000 + 1 FROM ev))) AS range"),
    "genes_ev": ("ev_sites", "SELECT range // 10 AS gene, min(range // 10) * 10 + 1 AS site_begin, min(range // 10) * 10 + 10 AS site_end FROM ev_sites GROUP BY 1"),
    "ev_states": ("", "SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS state"),
    "chars": ("", "SELECT doc_id AS taxon, unnest(range(length(text))) AS site, unnest(string_split(text, '')) AS ch FROM documents"),
    "cells_doc": ("chars", "SELECT taxon, site, CASE WHEN (ch >= 'a' AND ch <= 'z') OR (ch >= 'A' AND ch <= 'Z') THEN lower(ch) END AS state FROM chars"),
    "nuc_cells": ("cells_doc", "SELECT taxon, site, CASE WHEN state IS NOT NULL THEN substr('ACGT', ((ascii(state) - 97) % 4 + 1)::INT, 1) END AS state FROM cells_doc"),
    "code": ("", _code_values("universal")),
    "codon_cells": (
        "nuc_cells code",
        "SELECT t.taxon, t.site, c.codon AS state, c.aa, c.p1, c.p2, c.p3, coalesce(s.is_stop, false) AS stop FROM ("
        "SELECT taxon, site // 3 AS site, max(CASE WHEN site % 3 = 0 THEN state END) AS b1, max(CASE WHEN site % 3 = 1 THEN state END) AS b2, "
        "max(CASE WHEN site % 3 = 2 THEN state END) AS b3 FROM nuc_cells GROUP BY 1, 2) t "
        "LEFT JOIN code c ON NOT c.is_stop AND c.p1 = t.b1 AND c.p2 = t.b2 AND c.p3 = t.b3 "
        "LEFT JOIN code s ON s.is_stop AND s.p1 = t.b1 AND s.p2 = t.b2 AND s.p3 = t.b3",
    ),
    "neighbours": (
        "code",
        "SELECT *, aa_from = aa_to AS synonymous FROM (SELECT a.codon AS codon_from, b.codon AS codon_to, a.aa AS aa_from, b.aa AS aa_to, "
        "(CASE WHEN a.p1 <> b.p1 THEN 1 WHEN a.p2 <> b.p2 THEN 2 ELSE 3 END)::BIGINT AS pos, "
        "CASE WHEN a.p1 <> b.p1 THEN a.p1 WHEN a.p2 <> b.p2 THEN a.p2 ELSE a.p3 END AS nuc_from, "
        "CASE WHEN a.p1 <> b.p1 THEN b.p1 WHEN a.p2 <> b.p2 THEN b.p2 ELSE b.p3 END AS nuc_to "
        "FROM code a, code b WHERE NOT a.is_stop AND NOT b.is_stop "
        "AND (a.p1 <> b.p1)::INT + (a.p2 <> b.p2)::INT + (a.p3 <> b.p3)::INT = 1)",
    ),
    "trace_wide": (
        "ev",
        "SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY us) - 1 AS iter, value, "
        "json_extract_string(props, '$.k')::DOUBLE AS k FROM ev",
    ),
    "trace_ev": ("trace_wide", "SELECT run, iter, 'value' AS param, value FROM trace_wide UNION ALL SELECT run, iter, 'k', k FROM trace_wide"),
    "user_wide": (
        "ev",
        "SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS iter, value, "
        "json_extract_string(props, '$.k')::DOUBLE AS k FROM ev",
    ),
    "trace_user": ("user_wide", "SELECT run, iter, 'value' AS param, value FROM user_wide UNION ALL SELECT run, iter, 'k', k FROM user_wide"),
    "logl_li": (
        "",
        "SELECT l_linestatus AS run, l_partkey AS site, row_number() OVER (PARTITION BY l_linestatus, l_partkey "
        "ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS iter, -l_extendedprice / 10000 AS logl FROM lineitem",
    ),
    "stepping_li": ("", "SELECT l_returnflag AS run, l_suppkey AS cycle, -l_quantity / 10 AS delta, l_discount AS dlogprior FROM lineitem"),
    "scores": (
        "logl_li",
        "SELECT run, site, count(*) AS n, avg(logl) AS logl, var_pop(logl) AS var, "
        "min(lo) - ln(avg(exp(lo - logl))) AS logcpo, sum(exp(lo - logl)) ^ 2 / sum(exp(2 * (lo - logl))) AS ess_cpo, "
        "max(hi) + ln(avg(exp(logl - hi))) AS logpostmeanl, sum(exp(logl - hi)) ^ 2 / sum(exp(2 * (logl - hi))) AS ess_l "
        "FROM (SELECT *, min(logl) OVER (PARTITION BY run, site) AS lo, max(logl) OVER (PARTITION BY run, site) AS hi FROM logl_li) GROUP BY 1, 2",
    ),
    "stepping": (
        "stepping_li",
        "SELECT run, cycle, max(hi) + ln(avg(exp(delta - hi))) AS logz, avg(delta) AS meanlogp, avg(dlogprior) AS meanlogprior, "
        "var_pop(delta) AS varlogp, count(*) AS npoint, sum(exp(delta - hi)) ^ 2 / sum(exp(2 * (delta - hi))) AS ess "
        "FROM (SELECT *, max(delta) OVER (PARTITION BY run, cycle) AS hi FROM stepping_li) GROUP BY 1, 2",
    ),
    "order_mask": (
        "",
        "SELECT o_orderstatus AS run, l_orderkey AS iter, bit_or(1 << (l_suppkey % 8)::INT) AS raw, avg(l_discount) AS length "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    ),
    "splits_ord": ("order_mask", "SELECT run, iter, CASE WHEN raw & 1 = 1 THEN 255 - raw ELSE raw END AS m, length FROM order_mask WHERE raw <> 255"),
    "split_freq": (
        "splits_ord",
        "SELECT s.run, s.m, count(*) AS n, count(*) / any_value(t.n_trees)::DOUBLE AS prob, avg(length) AS mean_length "
        "FROM splits_ord s JOIN (SELECT run, count(*) AS n_trees FROM order_mask GROUP BY 1) t ON s.run = t.run GROUP BY 1, 2",
    ),
    "merged": (
        "splits_ord",
        "SELECT m, count(*) AS n, count(*) / (SELECT count(*) FROM order_mask)::DOUBLE AS prob, avg(length) AS mean_length FROM splits_ord GROUP BY 1",
    ),
    "order_leaves": (
        "",
        "SELECT l_orderkey, (l_suppkey % 8) AS t, min(l_returnflag) AS flag, round(avg(l_discount), 4) AS len FROM lineitem GROUP BY 1, 2",
    ),
    "order_clades": (
        "order_leaves",
        "SELECT l_orderkey, flag, count(*) AS size, list_sort(list('t' || t)) AS members FROM order_leaves GROUP BY 1, 2",
    ),
    "geo": (
        "",
        "SELECT s_suppkey AS s, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "cells_sup": (
        "",
        "SELECT taxon, site, CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS state FROM ("
        f"SELECT l_suppkey AS taxon, l_partkey AS site, {_A} AS a, {_N} AS n, {_R} AS r FROM lineitem GROUP BY 1, 2)",
    ),
    "rate_models": (
        "",
        f"SELECT d.draw, c.cat, c.rate, d.pa, d.pn, d.pr FROM (SELECT CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS draw, {_PI} FROM lineitem GROUP BY 1) d "
        "CROSS JOIN (VALUES (0, 0.5), (1, 1.0), (2, 1.5)) c(cat, rate)",
    ),
    "comp_models": ("", f"SELECT 0 AS draw, l_linenumber AS cat, 1.0 AS rate, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS w, {_PI} FROM lineitem GROUP BY 2"),
    "alloc_li": (
        "",
        "SELECT l_linenumber::BIGINT AS iter, l_partkey AS site, arg_min(l_suppkey % 10, (l_orderkey, l_suppkey, l_extendedprice)) AS comp FROM lineitem GROUP BY 1, 2",
    ),
    "prof_li": (
        "",
        f"SELECT iter, comp, unnest(['A', 'N', 'R']) AS state, unnest([pa, pn, pr]) AS freq FROM (SELECT l_linenumber::BIGINT AS iter, l_suppkey % 10 AS comp, {_PI} FROM lineitem GROUP BY 1, 2)",
    ),
    "rr_li": ("", "SELECT l_linenumber::BIGINT AS iter, l_returnflag AS s1, l_linestatus AS s2, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3"),
    "paths_ev": (
        "ev",
        "SELECT *, (coalesce(lead(seq_no) OVER w, 86400000000) - seq_no) / 86400000000.0 AS rel_time, lead(state) OVER w AS next_state FROM ("
        "SELECT CASE WHEN event_id % 2 = 0 THEN 'obs' ELSE 'pred' END AS run, us // 604800000000 AS iter, us // 86400000000 AS branch, "
        "user_id AS site, us % 86400000000 AS seq_no, event_type AS state FROM ev) WINDOW w AS (PARTITION BY run, iter, branch, site ORDER BY seq_no)",
    ),
    "li7": ("", "SELECT *, l_linenumber::BIGINT AS iter, l_suppkey % 4 AS comp FROM lineitem"),
    "nuc_stat": ("li7", _smoothed("iter", "l_suppkey % 4", list("ACGT"), "nuc")),
    "nuc_rr": ("li7", _smoothed("iter", "l_quantity::INT % 6", ["AC", "AG", "AT", "CG", "CT", "GT"], "pair")),
    "codon_profile": ("li7", _smoothed("iter", "l_orderkey % 61", _SENSE, "codon")),
    "aa_profile": ("li7", _smoothed("iter, comp", "l_quantity::INT % 20", list("ACDEFGHIKLMNPQRSTVWY"), "aa")),
    "ms_alloc": (
        "li7",
        "SELECT iter, site, CASE WHEN c0 >= c1 AND c0 >= c2 AND c0 >= c3 THEN 0 WHEN c1 >= c2 AND c1 >= c3 THEN 1 WHEN c2 >= c3 THEN 2 ELSE 3 END AS comp FROM ("
        "SELECT iter, l_partkey AS site, " + ", ".join(f"sum((comp = {i})::INT) AS c{i}" for i in range(4)) + " FROM li7 GROUP BY 1, 2)",
    ),
    "omega": ("li7", "SELECT iter, 1 + avg(l_discount) AS omega FROM li7 GROUP BY 1"),
    "stationary": (
        "code nuc_stat codon_profile aa_profile",
        "SELECT iter, comp, codon, q / sum(q) OVER (PARTITION BY iter, comp) AS prob FROM ("
        "SELECT p.iter, a.comp, p.codon, p.freq * s1.freq * s2.freq * s3.freq * a.freq AS q FROM codon_profile p JOIN code c ON p.codon = c.codon "
        "JOIN nuc_stat s1 ON s1.iter = p.iter AND s1.nuc = c.p1 JOIN nuc_stat s2 ON s2.iter = p.iter AND s2.nuc = c.p2 "
        "JOIN nuc_stat s3 ON s3.iter = p.iter AND s3.nuc = c.p3 JOIN aa_profile a ON a.iter = p.iter AND a.aa = c.aa)",
    ),
    "fluxes": (
        "stationary neighbours nuc_rr omega",
        "SELECT iter, comp, synonymous, s, mut, mut * CASE WHEN abs(s) < 1e-6 THEN 1 + s / 2 + s * s / 12 ELSE s / (1 - exp(-s)) END * "
        "CASE WHEN synonymous THEN 1 ELSE omega END AS sub FROM (SELECT t.iter, t.comp, n.synonymous, o.omega, rr.freq * ns.freq * t.prob AS mut, "
        "ln(ct.freq / cf.freq) + CASE WHEN n.synonymous THEN 0 ELSE ln(ab.freq / aa.freq) END AS s FROM stationary t "
        "JOIN neighbours n ON n.codon_from = t.codon JOIN nuc_rr rr ON rr.iter = t.iter AND rr.pair = least(n.nuc_from, n.nuc_to) || greatest(n.nuc_from, n.nuc_to) "
        "JOIN nuc_stat ns ON ns.iter = t.iter AND ns.nuc = n.nuc_to JOIN codon_profile cf ON cf.iter = t.iter AND cf.codon = n.codon_from "
        "JOIN codon_profile ct ON ct.iter = t.iter AND ct.codon = n.codon_to JOIN aa_profile aa ON aa.iter = t.iter AND aa.comp = t.comp AND aa.aa = n.aa_from "
        "JOIN aa_profile ab ON ab.iter = t.iter AND ab.comp = t.comp AND ab.aa = n.aa_to JOIN omega o ON o.iter = t.iter)",
    ),
    "hist": (
        "fluxes",
        "SELECT iter, comp, CASE WHEN s < -30 THEN 0 WHEN s > 30 THEN 240 ELSE greatest(1, ceil((s + 30) / 0.25 - 0.5)::INT) END AS bin, "
        "sum(mut) AS mut, sum(sub) AS sub, sum(CASE WHEN synonymous THEN 0 ELSE mut END) AS nonsyn_mut, sum(CASE WHEN synonymous THEN 0 ELSE sub END) AS nonsyn_sub, "
        "sum(CASE WHEN synonymous THEN mut ELSE 0 END) AS syn_mut, sum(CASE WHEN synonymous THEN sub ELSE 0 END) AS syn_sub FROM fluxes GROUP BY 1, 2, 3",
    ),
}


def mask_text(m: str = "m") -> str:
    """A split mask as taxon names joined with '|'."""
    return "concat_ws('|', " + ", ".join(f"CASE WHEN ({m}) & {1 << i} <> 0 THEN '{i}' END" for i in range(8)) + ")"


def _up(x: str, p: str) -> str:
    return f"ln(exp(-0.1 * rate) * {x} + (1 - exp(-0.1 * rate)) * ({p}))"


def pruning_sql(models: str, extra: str = "", matrix: str = "") -> str:
    """Fixed-depth pruning on the supplier tree as CTE bodies ``lk_n``, ``lk_r``, ``lk_root``, ``lk``.

    ``matrix`` names a table of transition matrices (draw, cat, t00, t01, ...) to use instead of the equal-rates process.
    """
    def level(src: str, parent: str) -> str:
        mix = "pa * xa + pn * xn + pr * xr"
        if matrix:
            moved = {k: f"ln(t{i}0 * xa + t{i}1 * xn + t{i}2 * xr)" for i, k in enumerate("anr")}
            src = f"{src} JOIN {matrix} USING (draw, cat)"
        else:
            moved = {k: _up("x" + k, mix) for k in "anr"}
        sums = ", ".join(f"sum({v}) AS l{k}" for k, v in moved.items())
        keys = f"{parent}site, draw, cat"
        model = "any_value(rate) AS rate, any_value(pa) AS pa, any_value(pn) AS pn, any_value(pr) AS pr"
        inner = f"SELECT {keys}, {model}, sum(scale) AS sc, {sums} FROM {src} GROUP BY {keys}"
        best = "greatest(t.la, t.ln, t.lr)"
        xs = ", ".join(f"exp(t.l{k} - {best}) AS x{k}" for k in "anr")
        return f"SELECT t.*, sc + {best} AS scale, {xs} FROM ({inner}) t"

    leaf = (
        f"SELECT g.s, g.n, g.r, c.site, m.draw, m.cat, m.rate, m.pa, m.pn, m.pr, (c.state = 'A')::INT::DOUBLE AS xa, (c.state = 'N')::INT::DOUBLE AS xn, "
        f"(c.state = 'R')::INT::DOUBLE AS xr, 0.0 AS scale FROM cells_sup c JOIN geo g ON g.s = c.taxon CROSS JOIN {models} m"
    )
    return (
        f"lk_leaf AS ({leaf}), lk_n AS ({level('lk_leaf', 'n, r, ')}), lk_r AS ({level('lk_n', 'r, ')}), lk_root AS ({level('lk_r', '')}), "
        f"lk AS (SELECT draw, site, cat, ln(pa * xa + pn * xn + pr * xr) + scale AS logl FROM lk_root){extra}"
    )
