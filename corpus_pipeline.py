"""A corpus in five stages: language ID, near-dedup, decontamination, secret removal, tokens.

Each stage works on all that the one before kept. ``run`` writes every stage's result as
Parquet into the shared folder the cluster names in ``spark.checkpoint.dir`` and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, decontaminate, lang_id, secret_scan, sentencepiece_bpe, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that holds much of them, go."""
    return lang_id.keep_identified(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    return simhash.keep_one_of_each(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows."""
    masked = docs.select(*COLUMNS).withColumn("text", secret_scan.redact(F.col("text")))
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, ids, n_tokens, and whether decoding gives the text back."""
    done = docs.select("doc_id", "text", "lang", sentencepiece_bpe.tokenize(spark, F.col("text")).alias("t"))
    return done.select(
        "doc_id",
        "lang",
        F.col("t.ids").alias("ids"),
        (F.octet_length("t.ids") / 4).cast("long").alias("n_tokens"),
        (F.col("t.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("secret_scan", remove_secrets),
    ("sentencepiece", encode_tokens),
]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = common.shared_folder(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
