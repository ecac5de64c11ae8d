"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's rows as Parquet in the shared folder and gives them to the next. All but the
last return the columns of documents. Rows are documents of their own, whatever their
ids: stages that need a key give each row one.

Defined results: language ID drops null texts and those without a letter; line dedup keeps a
document that loses all lines, with an empty text, and a null text stays null; near dedup
keeps the first row of each class in the order of (id, null first; text's digest; row), so
one of all empty texts; mixing drops empty texts, and rows come as often as it takes them;
packing packs what there is. The first and last stage set the session's
bytes of an Arrow batch, as their frames run after they have returned. Workers live on from stage to
stage: they give back the memory of a task when it is over, packing's table of words with it. An empty table gives an empty result in each stage; columns
that clash with none of a stage's own names and others alike come through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyframe.llm import common, language, lines, mixing, neardup, packing
from keyframe.llm.queries import tokenizer_path

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the rest (no letter, no text) goes."""
    common.bound_batches(spark)
    return language.with_language(docs)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of each row's own key, as ids may be null or repeat; and that column's name."""
    row = common.free_name("_row_key", docs)
    return common.with_row_keys(docs, row), row


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier line; n_chars follows the text."""
    rows, row = keyed(docs)
    return lines.without_duplicate_lines(rows, id_col=row, length_col="n_chars").drop(row)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, null before all others."""
    rows, row = keyed(docs)
    return neardup.representatives(rows, neardup.near_duplicate_classes(rows, id_col=row), id_col=row).drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each epoch, the last one cut where the mix stops."""
    rows, row = keyed(docs)
    return mixing.mixed_documents(rows, mixing.mix_sources(rows, id_col=row), id_col=row).drop(row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, neighbours along the curve together."""
    common.bound_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, keep=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Stages fit models and search near duplicates: tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
