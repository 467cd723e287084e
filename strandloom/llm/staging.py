"""Written tables in the cluster's shared folder, used to cut lineage.

A staged table is plain Parquet under ``spark.checkpoint.dir``: an executor that
is lost later costs at most a re-read, never a recomputation of what lies before.
"""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Used only where all runs in one process and the session names no folder (tests, a laptop).
LOCAL_DEFAULT = "/tmp/checkpoints/strandloom"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this application's staged tables and index files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    root = root or LOCAL_DEFAULT
    return f"{root.rstrip('/')}/strandloom-{spark.sparkContext.applicationId}"


#: Paths given out by this driver, in order.
_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def mark() -> int:
    """A point in time for ``release_since``."""
    return len(_made)


def release_since(spark: SparkSession, point: int, keep: DataFrame) -> None:
    """Delete what was staged since, but for one table, for which all the rest was made."""
    fs, _ = _folder(spark, shared_root(spark))
    for path in _made[point:]:
        if path != keep._staged_at:
            fs.delete(_folder(spark, path)[1], True)
    _made[point:] = [keep._staged_at]


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path of the shared folder, and the path there."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (pyarrow.fs.LocalFileSystem(), uri) if uri.startswith("/") else pyarrow.fs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of ``rows``, unless the session has a setting of its own.

    Spark's default of 10,000 texts a batch takes more memory, several times over, than
    all that is made of them.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(rows))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them is written too."""
    for table in tables:
        fs, place = _folder(table.sparkSession, table._staged_at)
        fs.delete(place, True)


#: Rows and written bytes up to which a side may be broadcast; a staged side is counted first.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def stage_side(df: DataFrame, label: str, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A staged join side, broadcast only if it has ``rows`` or fewer and its files ``size`` bytes or fewer."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    small_batches(spark)
    df.write.option("compression", "zstd").parquet(path)
    side = spark.read.schema(df.schema).parquet(path)
    fs, place = _folder(spark, path)
    small = fs.getContentSummary(place).getLength() <= size and side.limit(rows + 1).count() <= rows
    return side.hint("broadcast") if small else side


def release_all(spark: SparkSession) -> None:
    """Delete every table this application staged (call when results are written)."""
    fs, place = _folder(spark, shared_root(spark))
    fs.delete(place, True)
