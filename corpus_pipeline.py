"""Corpus pipeline: five stages, each one operator, each reading what the stage before wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import jaccard, language, lines, packing, secrets
from cladeframe.llm.common import read, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts that no language codes in fewer bits per byte are not prose of any of them (a byte has 8).
MAX_BITS_PER_BYTE = 6.5
MASK = "[SECRET]"


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    kept = docs.withColumn("text", F.col(text)).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return kept.select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters or that no language explains; fills a missing lang with the prediction."""
    found = language.identify_language(docs)
    good = (F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MAX_BITS_PER_BYTE)
    return found.filter(good).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; every document stays, if only with an empty text."""
    return _with_text(lines.dedup_lines(docs), "kept_text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Equal rows stay once. Rows without a doc_id can't be named by a group: of these
    only equal texts go.
    """
    found = jaccard.jaccard_components(docs)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(kept, "doc_id").dropDuplicates(["doc_id", "text"])
    nameless = docs.filter(F.col("doc_id").isNull()).dropDuplicates(["text"])
    return named.select(*COLUMNS).unionAll(nameless.select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, plain or encoded, is masked."""
    found = secrets.secret_spans(docs, redact=MASK)
    return _with_text(found, "clean_text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: The language model, the base64 worklist and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; every stage is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
