"""The queries of the operators, over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import (
    bpe,
    chat,
    collocations,
    jaccard,
    packing,
    quality,
    repeats,
    resampling,
    secrets,
    sharding,
    simhash,
    token_files,
    vectors,
)
from quire.llm.common import documents
from quire.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_counts(documents(spark, sf_dir)).select("doc_id", "n_tokens", "closed")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), words=3, part=90)


def op7_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_links(documents(spark, sf_dir), words=3, part=90)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "host_rejected")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text")
    return chat.chat_digest(turns.unionByName(chat.control_case(spark)))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_digest(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample_digest(documents(spark, sf_dir), target)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_packing, op2_sharding, op3_bpe, op4_secrets, op5_simhash, op6_token_counts,
        op7_ngram_join, op7_ngram_links, op8_quality, op9_chat, op10_repeats,
        op11_collocations, op12_top_products, op13_resampling)}

__all__ = ["ORACLES", "QUERIES"]
