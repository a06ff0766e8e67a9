"""The corpus pipeline: language ID, exact dedup, near dedup, mixing to target weights, byte-level BPE.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
documents; the last returns the documents' tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from covista.llm import bpe, exact_dedup, lang_id, mixing, near_dup
from covista.llm.common import bounded_batches, read_table, shared_dir
from covista.llm.queries import tokenizer

#: The least score of a document whose language counts as known. Prose in a learned language has about 0.5 and more.
LEAST_SCORE = 0.3
#: The share of the tokens that remain that the sample shall have.
BUDGET = 0.6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return lang_id.keep_known(docs, lang_id.fit(docs), LEAST_SCORE, relabel="lang")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_dup.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return mixing.sample(docs, budget=BUDGET)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return bpe.tokenised(docs, *tokenizer(), keep=("doc_id", "lang", "source"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("byte_bpe", tokens)]

#: Rank-order profiles, ProbMinHash and byte-pair merges are not expressible in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
