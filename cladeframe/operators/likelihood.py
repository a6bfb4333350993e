"""Per-site likelihood on a tree, distributed over sites, draws and tree levels.

``models([site,] draw, cat, rate, pi[, rr])`` lists what has to be evaluated: a rate
and a stationary profile for each category and draw, of one site or (without the
column) of every site in ``cells``. The equal-rates process
keeps a state with probability exp(-rate t) and else draws it from ``pi``; with ``rr``
(upper triangle of exchangeabilities) the general reversible process is used.

Two forms give the same numbers on trees of any size. ``site_loglik`` and
``ancestral_probs`` pass messages of packed model rows, see :mod:`messages`;
``site_loglik_levels`` needs built-ins only and knows the equal-rates process.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.logspace import weighted_log_sum, weighted_log_sums
from cladeframe.operators import messages
from cladeframe.operators.trees import LEVELS_PER_CUT
from cladeframe.session import durable

KEYS = ["draw", "site", "cat"]
#: Model rows of a task where nodes have a row for each of them.
MODEL_ROWS_AT_ONCE = 1 << 15


def site_loglik_levels(cells: DataFrame, nodes: DataFrame, models: DataFrame, states: list[str]) -> DataFrame:
    """(draw, site, cat, logl) under the equal-rates process, one aggregation per tree level.

    Only nodes with data below have rows: a missing leaf contributes a factor one.
    Log vectors are summed over children as columns, so every level combines on the
    map side and a node with very many children stays cheap. Rows are dealt by site, so
    that no level is shuffled, into as many tasks as the model rows need.
    """
    n = len(states)
    levels = {r.depth: r for r in nodes.groupBy("depth").agg(F.count("taxon").alias("leaves"), F.count_if(F.col("taxon").isNull()).alias("inner")).collect() if r.depth is not None}
    depth = max(levels, default=0)
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-models.count() // MODEL_ROWS_AT_ONCE))
    xs, ps = [f"x{k}" for k in range(n)], [f"p{k}" for k in range(n)]
    model = models.select(*KEYS, "rate", *[F.col("pi")[k].alias(p) for k, p in enumerate(ps)])
    tree = nodes.select("node", "parent", "taxon", "length", "depth")
    seen = cells.filter(F.col("state").isNotNull()).select(F.col("taxon").cast("string").alias("taxon"), "site", "state")
    leaf_sites = tree.filter(F.col("taxon").isNotNull()).join(seen, "taxon")
    leaf = leaf_sites.repartition(parts, "site").join(model.repartition(parts, "site"), "site").select(
        "node", "parent", "length", "depth", *KEYS, "rate",
        *[F.when(F.col("state") == s, 1.0).otherwise(0.0).alias(x) for s, x in zip(states, xs, strict=True)],
        *ps, F.lit(0.0).alias("scale"),
    )
    level = leaf.filter(F.col("depth") == depth)
    for d in range(depth - 1, -1, -1):
        stay = F.exp(-F.col("rate") * F.col("length"))
        mixed = sum((F.col(p) * F.col(x) for p, x in zip(ps[1:], xs[1:], strict=True)), F.col(ps[0]) * F.col(xs[0]))
        moved = level.withColumn("_stay", stay).withColumn("_mix", (1 - F.col("_stay")) * mixed)
        value = [F.col("_stay") * F.col(x) + F.col("_mix") for x in xs]
        summed = moved.select(
            F.col("parent").alias("node"), *KEYS, "rate", *ps, "scale",
            *[F.when(v > 0, F.log(v)).otherwise(float("-inf")).alias(x) for v, x in zip(value, xs, strict=True)],
        ).groupBy("node", *KEYS).agg(
            F.max("rate").alias("rate"), *[F.max(p).alias(p) for p in ps],
            F.sum("scale").alias("scale"), *[F.sum(x).alias(x) for x in xs],
        )
        top = F.greatest(*xs) if n > 1 else F.col(xs[0])
        # all states impossible: the scale is minus infinity and the vector zero
        shift = F.when(F.col("_top") > float("-inf"), F.col("_top")).otherwise(0.0)
        rescaled = summed.withColumn("_top", top).select(
            "node", *KEYS, "rate", *ps, (F.col("scale") + F.col("_top")).alias("scale"),
            *[F.exp(F.col(x) - shift).alias(x) for x in xs],
        )
        here = tree.filter((F.col("depth") == d) & F.col("taxon").isNull()).drop("taxon")
        if d in levels and levels[d].inner <= messages.NODES_AT_ONCE:
            here = F.broadcast(here)
        level = rescaled.join(here, "node")
        if d in levels and levels[d].leaves:
            level = level.unionByName(leaf.filter(F.col("depth") == d))
        if (depth - d) % LEVELS_PER_CUT == 0:
            level = durable(level)
    root = sum((F.col(p) * F.col(x) for p, x in zip(ps[1:], xs[1:], strict=True)), F.col(ps[0]) * F.col(xs[0]))
    logl = F.when(root > 0, F.log(root) + F.col("scale")).otherwise(float("-inf"))
    found = level.select(*KEYS, logl.alias("logl"), F.lit(True).alias("_data"))
    # a site without data has likelihood one
    joined = models.select(*KEYS).join(found, KEYS, "left")
    return joined.select(*KEYS, F.when(F.col("_data"), F.col("logl")).otherwise(0.0).alias("logl"))


def site_loglik(cells: DataFrame, nodes: DataFrame, models: DataFrame, states: list[str]) -> DataFrame:
    """(draw, site, cat, logl) by messages of packed model rows, for both processes and trees of any size."""
    k = len(states)
    weighted = models.withColumn("w", F.lit(1.0))
    tree = messages.tree_table(nodes)
    order = messages.Order.of(tree)
    if order is not None:
        return messages.block_logl(cells, tree, weighted, states, order)
    width = messages.block_width(messages.block_size(weighted)[0])
    packed = durable(messages.packed_for(cells, weighted, width))
    ups, inner, _ = messages.upward(cells, tree, packed, states, width)
    root = inner.filter(F.col("depth") == 0).select("node")
    return messages.root_logl(packed, ups.join(root, "node"), k)


def mixture_site_loglik(logl: DataFrame, weights: DataFrame) -> DataFrame:
    """log sum over components of w exp(logl): (draw, site); ``weights`` is (draw, cat, w)."""
    # a few weights meet the rows of all sites, so these rows stay where they are
    return weighted_log_sum(logl.join(F.broadcast(weights), ["draw", "cat"]), ["draw", "site"], "logl", "w", "logl")


def rate_mixture_loglik(logl: DataFrame, rates: DataFrame) -> DataFrame:
    """The same over rate categories; ``rates`` is (draw, cat, rate, w)."""
    return mixture_site_loglik(logl, rates.select("draw", "cat", "w"))


def total_loglik(site_logl: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Sum over (active) sites per draw."""
    kept = site_logl if active is None else site_logl.join(active.select("site"), "site", "left_semi")
    return kept.groupBy("draw").agg(F.sum("logl").alias("total_logl"))


def site_rate(logl: DataFrame, rates: DataFrame) -> DataFrame:
    """Posterior mean rate of every (draw, site): sum of w r L over sum of w L; null where the likelihood is zero."""
    weights = {"_num": F.col("w") * F.col("rate"), "_den": F.col("w")}
    sums = weighted_log_sums(logl.join(F.broadcast(rates), ["draw", "cat"]), ["draw", "site"], "logl", weights)
    rate = F.when(F.col("_den") > float("-inf"), F.exp(F.col("_num") - F.col("_den")))
    return sums.select("draw", "site", rate.alias("site_rate"))


def mean_site_rates(rates: DataFrame) -> DataFrame:
    return rates.groupBy("site").agg(F.avg("site_rate").alias("mean_rate"))


def ancestral_probs(
    cells: DataFrame, nodes: DataFrame, models: DataFrame, states: list[str], weights: DataFrame | None = None, raw_sum: bool = False
) -> DataFrame:
    """(node, site, state, prob) of the inner nodes, averaged over draws.

    Categories are weighted by w times their likelihood; ``raw_sum`` adds the
    normalised vectors without weights. Sites without data are left out.
    """
    k = len(states)
    weighted = models.withColumn("w", F.lit(1.0)) if weights is None else models.join(weights.select("draw", "cat", "w"), ["draw", "cat"])
    tree = messages.tree_table(nodes)
    order = messages.Order.of(tree)
    made = None if order is None else messages.block_posteriors(cells, tree, weighted, states, order, raw_sum)
    if made is None:
        width = messages.block_width(messages.block_size(weighted)[0])
        packed = durable(messages.packed_for(cells, weighted, width))
        ups, inner, depth = messages.upward(cells, tree, packed, states, width)
        made = messages.posterior_sums(messages.downward(durable(ups), inner, depth, k), k, raw_sum), False
    rows, single = made
    if single:
        means = rows.select("node", "site", *[(F.col(f"s{i}") / F.col("n")).alias(s) for i, s in enumerate(states)])
    else:
        means = rows.groupBy("node", "site").agg(*[(F.sum(f"s{i}") / F.sum("n")).alias(s) for i, s in enumerate(states)])
    return means.unpivot(["node", "site"], states, "state", "prob")


def expand_zip(zip_probs: DataFrame, orbits: DataFrame, profiles: DataFrame) -> DataFrame:
    """Spread the probability of the unobserved rest over its states by their profile share.

    ``zip_probs(node, site, state, prob)`` has null state for the rest; ``profiles`` is
    (site, state, freq) over the whole alphabet.
    """
    own = zip_probs.filter(F.col("state").isNotNull()).select("node", "site", "state", "prob")
    rest = zip_probs.filter(F.col("state").isNull()).select("node", "site", F.col("prob").alias("_rest"))
    unseen = (
        profiles.join(orbits.select("site", "orbit"), "site")
        .filter(~F.array_contains("orbit", F.col("state")))
    )
    total = unseen.groupBy("site").agg(F.sum("freq").alias("_all"))
    shared = rest.join(unseen.join(total, "site"), "site").select(
        "node", "site", "state", (F.col("_rest") * F.col("freq") / F.col("_all")).alias("prob")
    )
    return own.unionByName(shared)
