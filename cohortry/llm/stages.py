"""Stages of the training-data pipeline. Each one gets the documents that the stage before kept.

Every stage but the last returns the columns it got. Documents are told apart by doc_id.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.sources.shared import remember_written, shared_folder

from . import byte_bpe, decontaminate, language, minhash, secrets

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _measured(changed: DataFrame) -> DataFrame:
    """The length column, if there is one, follows the text."""
    if "n_chars" not in changed.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(changed.schema["n_chars"].dataType))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are in none of the labelled languages go: missing ones, those without a letter, and those whose
    phrases under the best language are hardly longer than a byte."""
    everything: Column = F.lit(True)
    return language.accepted(docs, language.train(language.training_sample(docs, everything)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return minhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; texts that consist of them for the most part go."""
    return _measured(decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return _measured(secrets.redact(docs, BYTE_BPE, PATTERN))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every text, decoded again to compare: token_ids, n_tokens and restored."""
    return byte_bpe.with_restored(docs, BYTE_BPE, PATTERN)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again.

    The tables of the stages stay until `remove_written`, as the result is read from the last of them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        remember_written(spark, f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
