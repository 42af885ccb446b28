"""The training-data pipeline over documents: five stages, each one operator.

Each stage takes and returns a table of documents (the last one the mix), is
written as Parquet, and works on all that the stage before it kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from isogloss.llm import common, decontaminate, language_id, mixing, near_dups, privacy


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language of a fair proportion, go."""
    return language_id.accepted(docs, language_id.fit(language_id.learn_rows(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return near_dups.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def sanitising(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data and what reveals it are replaced in the text."""
    return privacy.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words that it takes of each."""
    return mixing.mixed(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("privacy", sanitising), ("mixing", mix)]

#: Language models and fingerprints aren't expressible in SQL; tests hold the operators of the stages against brute force, and see what each stage keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    out = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
