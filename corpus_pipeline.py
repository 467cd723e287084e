"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontamination, line_dedup, mixing, simhash, staging, toxicity, wide_simhash


def _reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the models learn from the labels of the training folds."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines stay in one document only; a document that loses all is empty."""
    return line_dedup.drop_repeated_lines(docs)


def _keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, 0.8) the document of the least id stays.

    Wordless texts, among them those that lost all lines, are one class like in the
    operator itself.
    """
    return simhash.keep_one(docs, classes=wide_simhash.near_copies)


def _reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, however long they are."""
    return decontamination.reject_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets; adds ``mix_copy`` and ``mix_shard``."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", _reject_toxic),
    ("line_dedup", _drop_lines),
    ("simhash_near_dedup", _keep_one),
    ("decontamination", _reject_contaminated),
    ("mixing", _mix),
]

#: SQL has neither the models of the first stage nor the draws of the last; the tests
#: hold the rows against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them are staged as Parquet.

    What a stage staged for itself goes when its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    point = staging.mark()
    for name, step in STAGES[:-1]:
        docs = staging.stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        staging.release_since(spark, point, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
