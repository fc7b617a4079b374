"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing and token files, each a stage over what the last kept.

When a stage begins, the result of the one before has been written, so the tables that the one before had made on the way are removed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import decontamination, line_quality, mixing, near_dedup, token_files
from dialoom.llm.common import drop, made_inside, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_behind: list[str] = []


def _clears(stage: Stage) -> Stage:
    @wraps(stage)
    def cleared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _behind:
            drop(spark, _behind.pop())
        with made_inside() as made:
            out = stage(spark, docs, sf_dir)
        _behind.extend(made)
        return out

    return cleared


@_clears
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without the lines that stand in too many documents of their source."""
    return line_quality.clean(docs)


@_clears
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id."""
    return near_dedup.kept_rows(docs, k=5, percent=80)


@_clears
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with other numbers, names or units."""
    return decontamination.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_clears
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; documents of favoured sources stand twice."""
    return mixing.mixed_rows(docs)


@_clears
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_output(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("token output", token_output),
]

#: Sketching, template slots and token ids cannot be said in SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again; what a stage has read is removed
    once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                drop(spark, f"{folder}/{k - 1}")
    return docs
