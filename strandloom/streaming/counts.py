"""Running counters over arriving lane files (an extension: the counters are mergeable)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_counts(spark: SparkSession, folder: str, schema: str = "key string, label string") -> DataFrame:
    """Counts by key and label of Parquet files that arrive in ``folder``."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.where("key IS NOT NULL").groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))


def write_counts(counted: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each trigger replaces the table at ``path`` by all counts so far, in place of a merge."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counted.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
