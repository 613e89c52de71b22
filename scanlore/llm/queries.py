"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, divergence, exact, leaks, linededup, minhash, mixing, quality, resample, tokencount, toxicity
from .common import table


def vocabulary() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: The id that ends a document in a token file; the vocabulary leaves it free.
END_OF_DOCUMENT = 50256


def op1_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = given.unionByName(spark.createDataFrame(rows, given.schema))
    return chat.read_back(chat.format_chats(both, *vocabulary()))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.line_dedup(table(spark, sf_dir, "pages"))
    return kept.select("page_id", "host", "host_pages", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), *vocabulary())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.token_counts(table(spark, sf_dir, "documents"), *vocabulary(), END_OF_DOCUMENT)
    return counted.select("doc_id", "n_tokens")


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pruned_graph": op1_pruned_graph,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_chat_windows": op5_chat_windows,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_bagminhash": op10_bagminhash,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op6_line_dedup": linededup.ORACLE,
    "op7_exact_dedup": exact.ORACLE,
    "op11_benchmark_decontamination": leaks.ORACLE,
    "op12_importance_resampling": resample.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
