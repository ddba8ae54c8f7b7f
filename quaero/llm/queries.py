"""The query of each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, exact_dedup, mixing, near_dedup, ngram_join, ordinal, piece_tokens, quality_rules, token_store, url_rules, vector_codes, warc

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ordinal.train(docs, ordinal.grades_of(_table(spark, sf_dir, "labels")))
    return ordinal.graded(docs, model)


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chat.rotations(_table(spark, sf_dir, "conversations"))
    return parts.select(
        "conv_id", "assistant", "part", "n_turns", "start",
        F.sha2("text", 256).alias("text_sha256"),
        F.expr("aggregate(mask, 0L, (a, m) -> a + (m.end - m.start))").alias("masked_chars"),
        F.size("mask").cast("long").alias("n_masks"),
        F.sha2(F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), " "), 256).alias("mask_sha256"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), end_id=1)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.piece_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), with_ids=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages"), min_revisit_bytes=0))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_rules.judge(pages, url_rules.labelled_urls(spark, pages, _table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_exact_dedup, op2_ordinal_quality, op3_chat_rotation, op4_quality_rules, op5_token_store,
             op6_sentencepiece, op7_warc, op8_near_dedup, op9_url_rules, op10_mixing,
             op11_ngram_join, op12_vector_codes, op13_divergence)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL, "op3_chat_rotation": chat.SQL, "op7_warc": warc.SQL,
        "op12_vector_codes": vector_codes.SQL, "op13_divergence": divergence.SQL,
    }
