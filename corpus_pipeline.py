"""From raw documents to token ids: quality, copies, near copies, mixture, encoding.

Each stage takes what its predecessor kept. Stages but the last return the
columns of documents; run() writes each stage's rows to the shared folder and
reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quaero.llm import exact_dedup, mixing, near_dedup, piece_tokens, quality_rules
from quaero.llm.shared import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject."""
    return quality_rules.keep_good(docs)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest stays, then the smallest doc_id."""
    return exact_dedup.keep_first_copies(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at 0.8, the smallest doc_id stays."""
    return near_dedup.keep_one_of_each(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.repeat_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of ids and decoded text."""
    return piece_tokens.piece_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", good_documents),
    ("exact_dedup", one_of_equal),
    ("near_dedup", one_of_near),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: The mixture and the posterior of the rules cannot be written in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
