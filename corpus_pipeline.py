"""The corpus pipeline: language, near copies, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run``
applies them to ``documents`` and writes each result as Parquet for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import langmask, packing, paritysketch, personal, repeats
from sightline.shared import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that show one learned language: unlearned and evenly mixed ones and random letters go."""
    return langmask.told(docs, langmask.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group that shares at least 80 of 100 five-word shingles."""
    return paritysketch.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 35 words or more that stand elsewhere too; documents left empty go."""
    return repeats.without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return personal.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of the documents into sequences of 2048."""
    return packing.packed(docs)


STAGES = [
    ("language", language),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
