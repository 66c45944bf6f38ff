"""The corpus operators as registered queries, and their DuckDB forms."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import bpe, chat_format, exact_dedup, language_id, lm_scoring, packing, quality_rules, sharding, simhash, toxicity
from inkveil.llm.common import crc32_mod, prepare, table


def tokenizer_path() -> str:
    """The tokenizer file: INKVEIL_TOKENIZER, or the public one that is installed beside the library."""
    named = os.environ.get("INKVEIL_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(crc32_mod("doc_id", 4) != 2))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", (crc32_mod("row.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, labels.filter(crc32_mod("doc_id", 5) != 0))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", (crc32_mod("row.doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_lm_scoring, op3_exact_dedup, op4_packing, op5_sharding, op6_language_id, op7_toxicity, op8_bpe, op9_chat_format, op10_quality_rules)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Forms that DuckDB can run over whole tables; the other queries are tested against brute force."""
    return {
        "op2_lm_scoring": lm_scoring.ORACLE_SQL,
        "op3_exact_dedup": exact_dedup.ORACLE_SQL,
        "op9_chat_format": chat_format.ORACLE_SQL,
        "op10_quality_rules": quality_rules.ORACLE_SQL,
    }
