"""Join sides whose size is looked at before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Narrow rows that may be broadcast.
BROADCAST_ROWS = 2_000_000


def localized(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A dimension table as rows of the plan itself, if counted to be small; else ``df``."""
    held = df.limit(rows + 1).collect()
    return df.sparkSession.createDataFrame(held, df.schema) if len(held) <= rows else df


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join side with a broadcast hint if it is counted to be small."""
    held = localized(df)
    return F.broadcast(held) if held is not df or df.limit(rows + 1).count() <= rows else df
