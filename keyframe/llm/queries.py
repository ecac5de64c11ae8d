"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arrowfiles, language, lines, media, mixing, neardup, neighbours, packing, substrings, toxicity


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; KEYFRAME_TOKENIZERS names another folder."""
    if folder := os.environ.get("KEYFRAME_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media_features(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrowfiles.token_file_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeated_substrings(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_media_columns": op3_media_columns,
        "op4_toxicity": op4_toxicity,
        "op5_packing": op5_packing,
        "op6_token_files": op6_token_files,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_line_dedup": op9_line_dedup,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": mixing.ORACLE}
