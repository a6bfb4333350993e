"""Views that read the star-schema test tables as phylogenomic tables.

Each view uses whole tables. ``VIEW_SQL`` holds the same definitions for the SQL
check; :func:`with_views` puts the needed ones in front of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.alphabets import sense_codons
from cladeframe.functions.ordered import next_in_group, position_in_group
from cladeframe.functions.splits import canonical_split
from cladeframe.operators.alignment import count_columns

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
FLAGS = ["A", "N", "R"]
LETTERS = [chr(c) for c in range(ord("a"), ord("z") + 1)]
ORDER_TAXA = [str(i) for i in range(8)]
SIX_HOURS, FIVE_MINUTES, DAY = 21_600_000_000, 300_000_000, 86_400_000_000
# Order keys per ranking bucket of line items.
ORDER_BUCKET = 1 << 20
# Tasks for each split of a text table whose rows unfold into cells.
TASKS_PER_SPLIT = 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer files than cores, dealt out before they unfold into many cells.

    The count comes from the file listing; a table of many files is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text"))


def _micros(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("us", _micros())


def _latest_state(ev: DataFrame, keys: list[str]) -> DataFrame:
    """State of the latest event per key: time and state index packed into one long, so that it hash-aggregates."""
    names = F.array(*[F.lit(s) for s in EVENT_TYPES])
    unknown = F.raise_error(F.concat(F.lit("unknown event type: "), F.col("event_type"))).cast("bigint")
    place = F.array_position(names, F.col("event_type"))
    packed = F.col("us") * 8 + F.when(place > 0, place).otherwise(unknown)
    latest = ev.groupBy(*keys).agg(F.max(packed).alias("_m"))
    return latest.select(*keys, F.element_at(names, (F.col("_m") % 8).cast("int")).alias("state"))


def event_cells(spark: SparkSession, sf_dir: str, width: int, by_rep: bool = False) -> DataFrame:
    """taxon = user, site = time bucket, state = latest event type; buckets without an event are absent."""
    ev = events(spark, sf_dir).withColumn("taxon", F.col("user_id")).withColumn("site", F.floor(F.col("us") / width).cast("int"))
    if by_rep:
        return _latest_state(ev.withColumn("rep", F.col("event_id") % 10), ["rep", "taxon", "site"])
    return _latest_state(ev, ["taxon", "site"])


def cells_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cells(spark, sf_dir, SIX_HOURS)


def cells_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cells(spark, sf_dir, FIVE_MINUTES)


def cells_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cells(spark, sf_dir, SIX_HOURS, by_rep=True)


def n_sites(spark: SparkSession, sf_dir: str, width: int) -> int:
    """Sites of the event alignment: up to the bucket of the last event."""
    last = events(spark, sf_dir).agg(F.max("us")).first()[0]
    return 0 if last is None else last // width + 1


def genes_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of ten sites each, as many as the event alignment needs."""
    g = F.col("id").cast("int")
    return spark.range(-(-n_sites(spark, sf_dir, SIX_HOURS) // 10)).select(g.alias("gene"), (g * 10 + 1).alias("site_begin"), (g * 10 + 10).alias("site_end"))


def seqs_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as wide rows of raw characters."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("taxon"), F.split("text", "").alias("seq"))


def cells_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon = document, site = character position, state = lower-case letter, null for anything else."""
    c = F.col("ch")
    letter = F.when(((c >= "a") & (c <= "z")) | ((c >= "A") & (c <= "Z")), F.lower(c))
    return seqs_doc(spark, sf_dir).select("taxon", F.posexplode("seq").alias("site", "ch")).select("taxon", "site", letter.alias("state"))


def nuc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as nucleotide text: letter number mod 4 to A, C, G, T; other characters stay."""
    return _nuc_text(documents(spark, sf_dir))


def _nuc_text(docs: DataFrame) -> DataFrame:
    mapped = "".join("ACGT"[i % 4] for i in range(26))
    text = F.translate("text", "".join(LETTERS) + "".join(LETTERS).upper(), mapped + mapped)
    return docs.select(F.col("doc_id").alias("taxon"), text.alias("text"))


def nuc_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as wide rows of bases, null for anything else."""
    return _bases(nuc_text(spark, sf_dir))


def _bases(text: DataFrame) -> DataFrame:
    return text.select("taxon", F.transform(F.split("text", ""), lambda c: F.when(c.isin("A", "C", "G", "T"), c)).alias("seq"))


def nuc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of these rows. Rows are dealt by taxon before they unfold, so that groups of cells of a taxon need no shuffle."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_SPLIT * docs.rdd.getNumPartitions())
    return _bases(_nuc_text(docs.repartition(tasks, "doc_id"))).select("taxon", F.posexplode("seq").alias("site", "state"))


def event_trace(spark: SparkSession, sf_dir: str, run: str = "event_type") -> DataFrame:
    """run, iter by time inside the run, params value and k, long form."""
    ev = events(spark, sf_dir).select(
        F.col(run).alias("run"), "us", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    placed = position_in_group(ev, ["run"], ["us"], F.floor(F.col("us") / SIX_HOURS), "iter")
    return placed.select("run", "iter", "value", "k").unpivot(["run", "iter"], ["value", "k"], "param", "value")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem")


def logl_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run = line status, site = part, logl = -price / 10000; iter numbers the lines of a site in key order."""
    rows = lineitem(spark, sf_dir).select(
        F.col("l_linestatus").alias("run"), F.col("l_partkey").alias("site"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"
    )
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    placed = position_in_group(rows, ["run", "site"], order, F.floor(F.col("l_orderkey") / ORDER_BUCKET), "iter")
    return placed.select("run", "site", "iter", (-F.col("l_extendedprice") / 10000).alias("logl"))


def logl_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without draw numbers, for scores that ignore the order of draws."""
    return lineitem(spark, sf_dir).select(
        F.col("l_linestatus").alias("run"), F.col("l_partkey").alias("site"), (-F.col("l_extendedprice") / 10000).alias("logl")
    )


def stepping_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).select(
        F.col("l_returnflag").alias("run"), F.col("l_suppkey").alias("cycle"), (-F.col("l_quantity") / 10).alias("delta"), F.col("l_discount").alias("dlogprior")
    )


def taxa_ord() -> Column:
    return F.array(*[F.lit(t) for t in ORDER_TAXA])


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, n_trees): orders that have lines, by status."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_orderstatus").alias("run"))
    with_lines = orders.join(lineitem(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return with_lines.groupBy("run").agg(F.count(F.lit(1)).alias("n_trees"))


def splits_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run = order status, iter = order, split = suppliers mod 8 of its lines, length = mean discount."""
    mask = F.bit_or(F.expr("shiftleft(1, cast(l_suppkey % 8 as int))"))
    sets = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(mask.alias("_m"), F.avg("l_discount").alias("length"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("run"))
    bit = F.filter(taxa_ord(), lambda t: F.expr("_m").bitwiseAND(F.pow(F.lit(2), t.cast("int")).cast("int")) > 0)
    raw = sets.join(orders, "l_orderkey").select("run", F.col("l_orderkey").alias("iter"), bit.alias("split"), "length")
    return raw.withColumn("split", canonical_split(F.col("split"), taxa_ord())).filter(F.size("split") > 0)


def newick_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree per order over its suppliers mod 8: leaves grouped in clades by their smallest return flag.

    A leaf's length is its mean discount, a clade's length a tenth of its leaf number.
    """
    leaves = lineitem(spark, sf_dir).groupBy("l_orderkey", (F.col("l_suppkey") % 8).alias("t")).agg(
        F.min("l_returnflag").alias("flag"), F.round(F.avg("l_discount"), 4).alias("len")
    )
    leaf = F.format_string("t%d:%.4f", F.col("t"), F.col("len"))
    clades = leaves.groupBy("l_orderkey", "flag").agg(F.array_sort(F.collect_list(leaf)).alias("members"))
    size = F.size("members")
    text = F.when(size == 1, F.col("members")[0]).otherwise(
        F.concat(F.lit("("), F.array_join("members", ","), F.lit(")"), F.format_string(":%.1f", size / 10))
    )
    trees = clades.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("flag", text.alias("text")))).alias("c"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("run"))
    newick = F.concat(F.lit("("), F.array_join(F.transform("c", lambda x: x["text"]), ","), F.lit(");"))
    return trees.join(orders, "l_orderkey").select("run", F.col("l_orderkey").alias("iter"), newick.alias("newick"))


def tree_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root -> region -> nation -> supplier, 0.1 per edge; only nations that have a supplier."""
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    r = load(spark, sf_dir, "region").select("r_regionkey")
    all_three = s.join(n, "n_nationkey").join(r, "r_regionkey")

    def rows(df: DataFrame, node: Column, parent: Column, taxon: Column, depth: int, ix: Column) -> DataFrame:
        return df.select(
            node.alias("node"), parent.alias("parent"), taxon.cast("string").alias("taxon"),
            F.lit(0.1 if depth else None).cast("double").alias("length"), F.lit(depth).alias("depth"), ix.cast("bigint").alias("child_ix"),
        )

    none = F.lit(None).cast("string")
    leaf = rows(all_three, F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "n_nationkey"), F.col("s_suppkey"), 3, F.col("s_suppkey"))
    nations = all_three.select("n_nationkey", "r_regionkey").distinct()
    nation = rows(nations, F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "r_regionkey"), none, 2, F.col("n_nationkey"))
    region = rows(nations.select("r_regionkey").distinct(), F.concat(F.lit("r"), "r_regionkey"), F.lit("root"), none, 1, F.col("r_regionkey"))
    root = rows(spark.range(1), F.lit("root"), none, none, 0, F.lit(0))
    return leaf.unionByName(nation).unionByName(region).unionByName(root)


def cells_sup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon = supplier, site = part, state = most frequent return flag (ties: smallest letter)."""
    counts = lineitem(spark, sf_dir).groupBy(F.col("l_suppkey").alias("taxon"), F.col("l_partkey").alias("site")).agg(*count_columns(F.col("l_returnflag"), FLAGS))
    a, n, r = F.col("_c0"), F.col("_c1"), F.col("_c2")
    return counts.select("taxon", "site", F.when((a >= n) & (a >= r), "A").when(n >= r, "N").otherwise("R").alias("state"))


def flag_profiles(spark: SparkSession, sf_dir: str, by: Column) -> DataFrame:
    """(k, n, pi): return-flag shares of the lines of each value of ``by``."""
    counts = lineitem(spark, sf_dir).groupBy(by.alias("k")).agg(*count_columns(F.col("l_returnflag"), FLAGS))
    total = F.col("_c0") + F.col("_c1") + F.col("_c2")
    return counts.select("k", total.alias("n"), F.array(*[F.col(f"_c{i}") / total for i in range(3)]).alias("pi"))


RATES = [0.5, 1.0, 1.5]


def _rate_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = flag_profiles(spark, sf_dir, F.when(F.col("l_linestatus") == "F", 0).otherwise(1).cast("bigint"))
    rates = F.posexplode(F.array(*[F.lit(r) for r in RATES])).alias("cat", "rate")
    return draws.select(F.col("k").alias("draw"), "pi", rates)


def rate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two draws (line status) x three rates for every part; profile = flag shares of the draw."""
    return _rate_draws(spark, sf_dir).select("draw", "cat", "rate", "pi")


def part_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a row for every part."""
    packed = rate_models(spark, sf_dir).agg(F.collect_list(F.struct("draw", "cat", "rate", "pi"))).scalar()
    sites = lineitem(spark, sf_dir).select(F.col("l_partkey").alias("site")).distinct()
    return sites.select("site", F.explode(packed).alias("m")).select("m.draw", "site", "m.cat", "m.rate", "m.pi")


def rate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rate_draws(spark, sf_dir).select("draw", "cat", "rate", F.lit(1.0 / len(RATES)).alias("w"))


def comp_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw, one component per line number; profile = its flag shares, rate 1."""
    comps = flag_profiles(spark, sf_dir, F.col("l_linenumber"))
    return comps.select(F.lit(0).cast("bigint").alias("draw"), F.col("k").cast("int").alias("cat"), F.lit(1.0).alias("rate"), "pi")


def comp_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(draw, cat, w): share of the lines of each line number."""
    comps = flag_profiles(spark, sf_dir, F.col("l_linenumber"))
    total = comps.agg(F.sum("n")).scalar()
    return comps.select(F.lit(0).cast("bigint").alias("draw"), F.col("k").cast("int").alias("cat"), (F.col("n") / total).alias("w"))


def alloc_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run = li, iter = line number, site = part, comp = supplier mod 10 of the first line."""
    first = F.min(F.struct("l_orderkey", "l_suppkey", "l_extendedprice"))
    rows = lineitem(spark, sf_dir).groupBy(F.col("l_linenumber").alias("iter"), F.col("l_partkey").alias("site")).agg(first.alias("f"))
    return rows.select(F.lit("li").alias("run"), "iter", "site", (F.col("f.l_suppkey") % 10).alias("comp"))


def prof_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return-flag shares per (line number, supplier mod 10)."""
    counts = lineitem(spark, sf_dir).groupBy(F.col("l_linenumber").alias("iter"), (F.col("l_suppkey") % 10).alias("comp")).agg(*count_columns(F.col("l_returnflag"), FLAGS))
    total = F.col("_c0") + F.col("_c1") + F.col("_c2")
    shares = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), (F.col(f"_c{i}") / total).alias("freq")) for i, s in enumerate(FLAGS)]))
    return counts.select(F.lit("li").alias("run"), "iter", "comp", shares.alias("p")).select("run", "iter", "comp", "p.state", "p.freq")


def rr_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchangeabilities of return flag against line status per line number: mean quantity."""
    return lineitem(spark, sf_dir).groupBy(
        F.lit("li").alias("run"), F.col("l_linenumber").alias("iter"), F.col("l_returnflag").alias("s1"), F.col("l_linestatus").alias("s2")
    ).agg(F.avg("l_quantity").alias("value"))


def draws_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run = status, iter = order; alpha = total / 1e5, kappa = customer number mod 97."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("run"), F.col("o_orderkey").alias("iter"), (F.col("o_totalprice") / 100000).alias("alpha"), (F.col("o_custkey") % 97).cast("double").alias("kappa")
    )


def paths_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event sequences as paths: run = parity of the event id, iter = week, branch = day, site = user.

    ``seq_no`` is the time of day; ``rel_time`` the share of the day until the next event.
    """
    ev = events(spark, sf_dir).select(
        F.when(F.col("event_id") % 2 == 0, "obs").otherwise("pred").alias("run"),
        F.floor(F.col("us") / (7 * DAY)).alias("iter"), F.floor(F.col("us") / DAY).alias("branch"),
        F.col("user_id").alias("site"), (F.col("us") % DAY).alias("seq_no"), F.col("event_type").alias("state"),
    )
    nxt = next_in_group(ev, ["run", "iter", "branch", "site"], ["seq_no"], path_hour(), {"_next": "seq_no"})
    return nxt.withColumn("rel_time", (F.coalesce("_next", F.lit(DAY)) - F.col("seq_no")) / DAY).drop("_next")


def path_hour() -> Column:
    """Order-preserving bucket of the event paths."""
    return F.floor(F.col("seq_no") / 3_600_000_000)


def mutsel(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Mutation-selection tables counted from the line items, seven draws (line numbers).

    Every frequency is (count + 1) over its total, so none is zero.
    """
    li = lineitem(spark, sf_dir).withColumn("run", F.lit("li")).withColumn("iter", F.col("l_linenumber"))
    draw = ["run", "iter"]

    def smoothed(keys: list[str], slot: Column, names: list[str], name: str) -> DataFrame:
        counts = li.withColumn("_s", slot.cast("int")).groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"))
        totals = counts.groupBy(*keys).agg((F.sum("_c") + len(names)).alias("_t"))
        grid = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("_s"))
        label = F.array(*[F.lit(v) for v in names])[F.col("_s")]
        freq = (F.coalesce("_c", F.lit(0)) + 1) / F.col("_t")
        return grid.join(counts, [*keys, "_s"], "left").select(*keys, label.alias(name), freq.alias("freq"))

    pairs = ["AC", "AG", "AT", "CG", "CT", "GT"]
    rr = smoothed(draw, F.col("l_quantity") % 6, pairs, "pair").select(
        *draw, F.substring("pair", 1, 1).alias("n1"), F.substring("pair", 2, 1).alias("n2"), F.col("freq").alias("value")
    )
    li = li.withColumn("comp", F.col("l_suppkey") % 4)
    comps = li.groupBy(*draw, F.col("l_partkey").alias("site")).agg(*[F.count(F.when(F.col("comp") == i, 1)).alias(f"_c{i}") for i in range(4)])
    best = F.array_position(F.array(*[F.col(f"_c{i}") for i in range(4)]), F.greatest(*[F.col(f"_c{i}") for i in range(4)])) - 1
    return {
        "nuc_stat": smoothed(draw, F.col("l_suppkey") % 4, list("ACGT"), "nuc"),
        "nuc_rr": rr,
        "codon_profile": smoothed(draw, F.col("l_orderkey") % 61, sense_codons(), "codon"),
        "aa_profile": smoothed([*draw, "comp"], F.col("l_quantity") % 20, list("ACDEFGHIKLMNPQRSTVWY"), "aa"),
        "alloc": comps.select(*draw, "site", best.alias("comp")),
        "omega": li.groupBy(*draw).agg((1 + F.avg("l_discount")).alias("omega")),
        "lengths": li.groupBy(*draw).agg(F.avg("l_tax").alias("tree_length")),
    }
