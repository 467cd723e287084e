"""Folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a folder of this machine only where all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return f"{(root or '/tmp/strandloom-files').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table at ``path``; without dictionaries, which texts that differ fill in vain."""
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: what lies before it is not computed again."""
    return staged(df, new_folder(df.sparkSession, name))
