"""The registered queries of this subpackage: name -> (spark, folder of tables) -> rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import chat, decontam, divergence, ftrl, langid, neardup, packing, periodic, quality, suffix, tokenbin, tokencount, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.with_probe(_table(spark, sf_dir, "conversations"))
    return chat.conversation_digests(chat.format_conversations(messages))


def op2_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_all(_table(spark, sf_dir, "documents"))


def op4_latent_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_file_digests(_table(spark, sf_dir, "documents"))


def op6_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, threshold=80)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op8_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(_table(spark, sf_dir, "documents")).drop("tie")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), urlfilter.QUERY_RULES)


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.collapse_runs(_table(spark, sf_dir, "documents"), periodic.planted))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.score_all(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_isolation_forest": op2_isolation_forest,
        "op3_ecoc_language": op3_ecoc_language,
        "op4_latent_semantic": op4_latent_semantic,
        "op5_token_orc": op5_token_orc,
        "op6_minhash_hamming": op6_minhash_hamming,
        "op7_token_counts": op7_token_counts,
        "op8_sparse_suffix": op8_sparse_suffix,
        "op9_url_filter": op9_url_filter,
        "op10_pattern_packing": op10_pattern_packing,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_source_divergence": op12_source_divergence,
        "op13_ftrl_quality": op13_ftrl_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.ORACLE_SQL, "op9_url_filter": urlfilter.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
