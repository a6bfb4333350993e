"""Text output of running chains to tables: traces, trees, scores and chain points.

Record numbers follow the order in each file. A record is placed by the start of its
file split and its order inside the split, so numbering stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.ordered import position_in_group


def run_name() -> Column:
    """The file name without its ending."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def _located(df: DataFrame) -> DataFrame:
    """Add run (file name without ending) and the position of the record."""
    return df.select("*", run_name().alias("run"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))


def _numbered(located: DataFrame, name: str = "iter") -> DataFrame:
    return position_in_group(located, ["run"], ["_start", "_row"], F.col("_start"), name).drop("_start", "_row")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(run, iter, newick): one record per tree, ended by ';' over any number of lines."""
    pieces = _located(spark.read.text(path, lineSep=";"))
    return parse_trees(_numbered(pieces.filter(F.trim(F.regexp_replace("value", r"\s+", "")).startswith("("))))


def parse_trees(records: DataFrame) -> DataFrame:
    """Records (run, iter, value) without their ';' to Newick text without white space."""
    text = F.regexp_replace("value", r"\s+", "")
    return records.select("run", "iter", F.concat(text, F.lit(";")).alias("newick")).filter(F.col("newick").startswith("("))


def read_traces(spark: SparkSession, path: str, drop: int = 3) -> DataFrame:
    """Long trace(run, iter, param, value); the first ``drop`` columns are left out.

    Every file is read by its own header, so runs with other columns do not mix.
    """
    lines = _located(spark.read.text(path).filter(F.trim("value") != ""))
    return parse_traces(_numbered(lines), drop)


def parse_traces(lines: DataFrame, drop: int = 3) -> DataFrame:
    """Trace lines (run, iter, value), the header of a run at iter 0, to long rows numbered from 0."""
    fields = F.transform(F.split(F.rtrim("value"), "\t"), lambda x: F.trim(x))
    cut = lines.select("run", "iter", fields.alias("_v"))
    heads = cut.filter("iter = 0").select("run", F.col("_v").alias("_h"))
    body = cut.filter("iter > 0").join(heads, "run")
    cells = body.select("run", (F.col("iter") - 1).alias("iter"), F.posexplode("_h").alias("_i", "param"), "_v")
    kept = cells.filter((F.col("_i") >= drop) & (F.col("param") != ""))
    return kept.select("run", "iter", "param", F.get("_v", F.col("_i")).cast("double").alias("value"))


def read_site_scores(spark: SparkSession, path: str) -> DataFrame:
    """Per-site score files: a header line and seven tab-separated columns; site numbers start at 1."""
    return parse_site_scores(spark.read.text(path).select(run_name().alias("run"), "value"))


SITE_SCORES = ["logl", "var", "logcpo", "ess_cpo", "logpostmeanl", "ess_l"]


def parse_site_scores(lines: DataFrame) -> DataFrame:
    """Score lines (run, value) to columns; lines that do not begin with a site number are headers."""
    fields = F.transform(F.split("value", "\t"), lambda x: F.trim(x))
    cut = lines.select("run", fields.alias("_v")).filter(F.col("_v")[0].rlike(r"^\d+$"))
    columns = [F.get("_v", F.lit(i)).cast("double").alias(n) for i, n in enumerate(SITE_SCORES, 1)]
    return cut.select("run", F.col("_v")[0].cast("int").alias("site"), *columns)


STEPPING = ["frac", "nsite", "logz", "meanlogp", "meanlogprior", "varlogp", "npoint", "ess"]
PILOT = ["pilot_logz", "pilot_meanlogp", "pilot_meanlogprior", "pilot_varlogp", "pilot_npoint", "pilot_ess"]


def read_stepping(spark: SparkSession, path: str) -> DataFrame:
    """Stepping files of eight columns, or fourteen with a pilot pass; the cycle is the line number."""
    located = _located(spark.read.text(path).filter(F.trim("value") != ""))
    return parse_stepping(_numbered(located, "cycle"))


def parse_stepping(lines: DataFrame) -> DataFrame:
    """Stepping lines (run, cycle, value) to columns."""
    lines = lines.withColumn("_w", F.split(F.trim("value"), r"\s+"))
    columns = [F.get(F.col("_w"), i).cast("double").alias(n) for i, n in enumerate(STEPPING + PILOT)]
    return lines.select("run", "cycle", *columns).withColumn("npoint", F.col("npoint").cast("bigint"))


def read_site_logl(spark: SparkSession, path: str) -> DataFrame:
    """Draw x site matrix, one line per draw, to site_logl(run, iter, site, logl)."""
    return parse_site_logl(_numbered(_located(spark.read.text(path).filter(F.trim("value") != ""))))


def parse_site_logl(lines: DataFrame) -> DataFrame:
    """Matrix lines (run, iter, value), one value per site."""
    return lines.select("run", "iter", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("site", "_v")).select(
        "run", "iter", "site", F.col("_v").cast("double").alias("logl")
    )


def read_draws(spark: SparkSession, path: str, states: list[str], scalars: tuple[str, ...] = ("branchalpha", "branchbeta", "alpha")) -> dict[str, DataFrame]:
    """Chain files of a profile mixture to tables: trees, draws, dirweight, profiles and alloc.

    A point is a tree ended by ';', then ``scalars``, the number of components, kappa,
    one weight per state, a profile per component and a component per site. Records are
    cut at ';', so the text behind a cut holds the numbers of one point and the tree of
    the next.
    """
    return parse_draws(_numbered(_located(spark.read.text(path, lineSep=";")), "_piece"), states, scalars)


def parse_draws(pieces: DataFrame, states: list[str], scalars: tuple[str, ...]) -> dict[str, DataFrame]:
    """Pieces (run, _piece, value) of chain files, cut at ';', to the tables of ``read_draws``."""
    k, n = len(states), len(scalars)
    tree = F.regexp_replace(F.regexp_extract("value", r"(?s)(\(.*)$", 1), r"\s+", "")
    trees = pieces.select("run", F.col("_piece").alias("iter"), tree.alias("_t")).filter(F.col("_t") != "")
    numbers = F.split(F.trim(F.regexp_replace(F.regexp_replace("value", r"(?s)\(.*$", ""), r"\s+", " ")), " ")
    numbers = F.filter(numbers, lambda x: x != "")
    points = pieces.filter(F.col("_piece") > 0).select("run", (F.col("_piece") - 1).alias("iter"), numbers.cast("array<double>").alias("v"))
    points = points.filter(F.size("v") > n + 2 + k).withColumn("ncomp", F.col("v")[n].cast("int"))
    names = F.array(*[F.lit(s) for s in states])

    def cut(start: Column, length: Column) -> Column:
        return F.slice("v", start, length)

    weights = points.select("run", "iter", F.posexplode(cut(F.lit(n + 3), F.lit(k))).alias("_i", "value"))
    profiles = points.select("run", "iter", F.posexplode(cut(F.lit(n + 3 + k), F.col("ncomp") * k)).alias("_i", "freq"))
    first_site = F.lit(n + 3 + k) + F.col("ncomp") * k
    alloc = points.select("run", "iter", F.posexplode(cut(first_site, F.size("v") - first_site + 1)).alias("site", "_c"))
    return {
        "trees": trees.select("run", "iter", F.concat("_t", F.lit(";")).alias("newick")),
        "draws": points.select("run", "iter", *[F.col("v")[i].alias(s) for i, s in enumerate(scalars)], "ncomp", F.col("v")[n + 1].alias("kappa")),
        "dirweight": weights.select("run", "iter", names[F.col("_i")].alias("state"), "value"),
        "profiles": profiles.select("run", "iter", F.floor(F.col("_i") / k).cast("int").alias("comp"), names[F.col("_i") % k].alias("state"), "freq"),
        "alloc": alloc.select("run", "iter", "site", F.col("_c").cast("int").alias("comp")),
    }


def write_draws(tables: dict[str, DataFrame], path: str) -> None:
    """Parsed chains as Parquet partitioned by run, so that thinning reads only the runs and draws it keeps."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("run").parquet(f"{path}/{name}")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene partition: a count, then lines 'index begin end' (1-based, inclusive)."""
    return parse_genes(spark.read.text(path))


def parse_genes(lines: DataFrame) -> DataFrame:
    """Gene lines (value); shorter lines, such as the count, are skipped."""
    lines = lines.select(F.split(F.trim("value"), r"\s+").alias("w")).filter(F.size("w") >= 3)
    return lines.select(*[F.col("w")[i].cast("int").alias(c) for i, c in enumerate(("gene", "site_begin", "site_end"))])


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Excluded genes: a count, then that many 1-based gene numbers."""
    return parse_exclusions(spark.read.text(path, wholetext=True))


def parse_exclusions(texts: DataFrame, *keys: str) -> DataFrame:
    """Whole texts (keys, value): a count, then that many gene numbers."""
    whole = texts.select(*keys, F.split(F.trim("value"), r"\s+").alias("w"))
    return whole.select(*keys, F.explode(F.slice("w", F.lit(2), F.col("w")[0].cast("int"))).alias("gene")).withColumn("gene", F.col("gene").cast("int"))


def read_mixture(spark: SparkSession, path: str, floor: float = 1e-8) -> DataFrame:
    """Empirical mixture to (name, comp, weight, state, freq).

    Layout: number of states, the letters, number of components, then per component a
    weight and its profile. Frequencies are raised to ``floor``; profiles and weights
    are normalised.
    """
    return parse_mixture(spark.read.text(path, wholetext=True).select(run_name().alias("name"), "value"), floor)


def parse_mixture(texts: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Whole mixture texts (name, value) to rows."""
    whole = texts.select("name", F.split(F.trim("value"), r"\s+").alias("w"))
    k = F.col("w")[0].cast("int")
    shape = whole.select("name", k.alias("k"), F.slice("w", F.lit(2), k).alias("letters"), F.expr("slice(w, cast(w[0] as int) + 3, size(w))").alias("rest"))
    rows = shape.withColumn("_n", F.floor(F.size("rest") / (F.col("k") + 1))).withColumn("comp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    start = (F.col("comp") * (F.col("k") + 1) + 1).cast("int")
    profile = F.transform(F.slice("rest", start + 1, F.col("k")), lambda x: F.greatest(x.cast("double"), F.lit(floor)))
    cut = rows.select("name", F.col("comp").cast("int").alias("comp"), "letters", F.element_at("rest", start).cast("double").alias("_w"), profile.alias("_p"))
    total = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)
    sums = cut.groupBy("name").agg(F.sum("_w").alias("_all"))
    scaled = cut.join(sums, "name").select("name", "comp", (F.col("_w") / F.col("_all")).alias("weight"), "letters", F.transform("_p", lambda x: x / total).alias("_p"))
    return scaled.select("name", "comp", "weight", F.explode(F.arrays_zip(F.col("letters").alias("state"), F.col("_p").alias("freq"))).alias("_z")).select(
        "name", "comp", "weight", F.col("_z.state").alias("state"), F.col("_z.freq").alias("freq")
    )


def read_posthyper(spark: SparkSession, path: str) -> DataFrame:
    """(run, line, shape, rate): the two-column lines of a prior table, numbered in file order."""
    located = _located(spark.read.text(path).filter(F.trim("value") != ""))
    return parse_posthyper(_numbered(located, "line"))


def parse_posthyper(lines: DataFrame) -> DataFrame:
    """Prior lines (run, line, value) with two numbers."""
    lines = lines.withColumn("_w", F.split(F.trim("value"), r"\s+"))
    return lines.filter(F.size("_w") == 2).select("run", "line", F.col("_w")[0].cast("double").alias("shape"), F.col("_w")[1].cast("double").alias("rate"))
