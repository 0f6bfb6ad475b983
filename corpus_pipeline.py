"""A corpus pipeline in five stages, each on all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again for the next one. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, language, ngram_join, queries, secret_scan, tiling
from sievework.llm._common import cut, small
from sievework.operators.graph import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't found with a probability of one half or more.

    The verdict depends on a row's text and source only, so rows are dropped by two
    64-bit hashes of these, whatever their id.
    """
    model = language.train_language(docs)
    given = [F.col(c).isNull() for c in ("text", "source")] + [F.col("text"), F.col("source")]
    keys = {"_sw_one": F.xxhash64(F.lit(1), *given), "_sw_two": F.xxhash64(F.lit(2), *given)}
    judged = language.identify_language(docs.select(*[c.alias(k) for k, c in keys.items()], "text", F.col("source").alias("host")), model, host=F.col("host"))
    rejected = small(cut(judged.where("not accepted").select(*keys).distinct()))
    return docs.withColumns(keys).join(rejected, list(keys), "left_anti").drop(*keys)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each group that links by five-word shingles at 0.8 or more."""
    return ngram_join.one_per_component(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark text to 0.8 or more by tiles of five words or more."""
    return tiling.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; ``n_chars`` is that of the new text."""
    clean = secret_scan.scan_secrets(docs, redact="[SECRET]")
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint"))).select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of the texts and their number."""
    ids = bpe.bpe_encode(docs, queries.tokenizer_path())
    return ids.withColumn("n_tokens", F.size("token_ids"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("bpe", tokenised),
]

#: Trained models, hashed joins and tokenisers have no SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages make of ``documents``.

    What stages hand on is written to the folder of ``spark.checkpoint.dir``; where
    that is unset, a local session (tests) takes a temporary one.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
