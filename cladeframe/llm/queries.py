"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import (
    chat,
    idfiles,
    jaccard,
    language,
    licenses,
    lines,
    packing,
    repetition,
    resample,
    secrets,
    segments,
    vectors,
    zonemaps,
)
from cladeframe.llm.common import read


PROBE = "</s>[INST] ok [/INST]"


def op1_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    nodes, convs = chat.format_conversations(rows.unionAll(probe))
    told = chat.read_back(nodes, convs)
    return convs.join(told, convs["node"] == told["leaf"]).select(
        "conv_id", F.col("read_turns").alias("n_turns"), "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_coverage(read(spark, sf_dir, "documents"))


def op3_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op4_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op5_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_language(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.secret_spans(read(spark, sf_dir, "documents")))


def op9_gumbel_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.sample_segmentations(read(spark, sf_dir, "documents"), with_digest=True)


def op10_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.license_scan(read(spark, sf_dir, "documents")))


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.encode_table(read(spark, sf_dir, "documents"))


def op13_hilbert_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemaps.cluster_vectors(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_prefix_tree": op1_prefix_tree,
    "op2_repetition_coverage": op2_repetition_coverage,
    "op3_product_codes": op3_product_codes,
    "op4_prefix_jaccard": op4_prefix_jaccard,
    "op5_context_trees": op5_context_trees,
    "op6_line_runs": op6_line_runs,
    "op7_bin_slack": op7_bin_slack,
    "op8_secret_layers": op8_secret_layers,
    "op9_gumbel_segments": op9_gumbel_segments,
    "op10_license_join": op10_license_join,
    "op11_importance_draw": op11_importance_draw,
    "op12_id_blocks": op12_id_blocks,
    "op13_hilbert_zones": op13_hilbert_zones,
}



def _kmeans_sql(rounds: int = 10, many: int = 8, dim: int = 64) -> str:
    """Every round as two steps: the nearest centroid of every vector, and the floored means."""
    finite = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    far = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dim} AND {finite})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {many})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, any_value(vec_id) AS vec_id, any_value(k.v) AS v, min((d, c))[2] AS c, min(d) AS d FROM (SELECT k.i, k.vec_id, k.v, c.c, {far} AS d FROM kept k, c{r} c) k GROUP BY i)")
        if r < rounds:
            steps.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS v FROM "
                f"(SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dim})) AS p FROM a{r}) GROUP BY 1, 2) GROUP BY 1) m USING (c))"
            )
    return "WITH " + ", ".join(steps) + (
        f" SELECT vec_id, a.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(e.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} e ON e.c = a.c"
    )


_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op6_line_runs": f"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        rows AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
        keyed AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM rows),
        frequent AS (SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.owner AS lost FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op13_hilbert_zones": _kmeans_sql(),
}
