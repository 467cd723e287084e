"""Small text formats: counters, sample sheets, key lists, BED, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.keys import index_only, parse_key
from ..operators.barcodes import reference_set
from ..operators.sizes import sized
from .parts import assemble, join_parts, write_parts


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``value, ordinal`` of a small file's lines in order, from 0 (one file, one partition)."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("lines"))
    return lines.select(F.posexplode("lines").alias("ordinal", "value"))


def write_lines(lines: DataFrame, order: list[str], path: str) -> str:
    """One text file of the column ``value`` in the order of other columns: parts by all tasks, their bytes joined."""
    encode = lambda batch: "".join([f"{x}\n" for x in batch.column("value").to_pylist()]).encode()
    if not assemble(lines.sparkSession, write_parts(lines.withColumn("__target", F.lit(path)), order, encode)):
        join_parts(path, [])
    return path


def read_reference_set(spark: SparkSession, path: str) -> DataFrame:
    """``label, ordinal, augmented_label, barcode, length`` of a barcode file."""
    return reference_set(_numbered(spark, path).select("value"))


def parse_counter(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counter text (``value, ordinal``) as tidy rows with ``file_ordinal``, and its ``total``.

    The first line is the total, each other a key and label-count pairs, tab-separated.
    Repeated keys and labels add up.
    """
    parts = F.split("value", "\t")
    rows = lines.where("ordinal > 0 AND value <> ''").select((F.col("ordinal") - 1).alias("file_ordinal"), parts.alias("parts"))
    at = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: (i % 2 == 1) & (i + 1 < F.size("parts")))
    pairs = F.transform(at, lambda i: F.struct(((i + 1) / 2).cast("int").alias("label_ordinal"), F.get("parts", i).alias("label"), F.get("parts", i + 1).cast("long").alias("n")))
    each = rows.select("file_ordinal", F.get("parts", F.lit(0)).alias("key"), F.explode_outer(pairs).alias("p")).select("file_ordinal", "key", "p.*")
    tidy = each.where("label IS NOT NULL").groupBy("key", "label").agg(F.min("file_ordinal").alias("file_ordinal"), F.min("label_ordinal").alias("label_ordinal"), F.sum("n").alias("n"))
    return tidy, lines.where("ordinal = 0").select(F.trim("value").cast("long").alias("total"))


def read_counter(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_counter(_numbered(spark, path))


def parse_sample_sheet(lines: DataFrame, lengths: DataFrame) -> DataFrame:
    """``key, length`` of index pairs from the first column of a sheet, up to its first empty line.

    Barcodes are ``:``-joined sets; the length is that of their first member. p5 and p7
    must agree, index pairs have one length, and lengths above 0 must be in ``lengths``.
    """
    last = lines.where("value = ''").agg(F.min("ordinal").alias("stop"))
    rows = lines.crossJoin(F.broadcast(last)).where("stop IS NULL OR ordinal < stop")
    parts = parse_key(F.get(F.split("value", "\t"), F.lit(0)))
    one = lambda c: F.coalesce(F.char_length(F.substring_index(F.col("k")[c], ":", 1)), F.lit(0))
    rows = rows.select(parts.alias("k"), F.get(F.split("value", "\t"), F.lit(0)).alias("whole")).select(index_only("whole").alias("key"), one("p5").alias("a"), one("p7").alias("b"))
    known = sized(lengths.select(F.col("length").alias("__length")).distinct())
    rows = rows.join(known, F.col("a") == F.col("__length"), "left")
    found = rows.groupBy("key").agg(F.min("a").alias("length"), F.max("a").alias("high"), F.max((F.col("a") != F.col("b")).cast("int")).alias("uneven"), F.max(((F.col("a") > 0) & F.col("__length").isNull()).cast("int")).alias("unknown"))
    ok = (F.col("length") == F.col("high")) & (F.col("uneven") == 0) & (F.col("unknown") == 0)
    return found.select("key", F.when(ok, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("inconsistent barcode lengths: "), "key")).cast("int")).alias("length"))


def parse_keys(lines: DataFrame) -> DataFrame:
    """Explicit keys: the first column; lines that hold no key are skipped."""
    first = F.get(F.split("value", "\t"), F.lit(0))
    return lines.select(first.alias("key"), parse_key(first).alias("p")).where("p IS NOT NULL").select("key").distinct()


def parse_bed(lines: DataFrame) -> DataFrame:
    """``chrom, start0, end, name``: tab or space separated, 0-based and half-open."""
    parts = F.split(F.trim("value"), r"[\t ]+")
    rows = lines.where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    return rows.select(F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).cast("int").alias("start0"), F.get(parts, F.lit(2)).cast("int").alias("end"), F.get(parts, F.lit(3)).alias("name"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(spark.read.text(path))


def parse_metrics(lines: DataFrame, column: str = "UNPAIRED_READ_DUPLICATES") -> DataFrame:
    """One row ``n`` of a duplicate-metrics file (``value, ordinal``).

    After comments and blank lines the first line names the columns and the next has the
    values. Without lines 0, without the column -1.
    """
    rows = lines.where("value <> '' AND NOT startswith(value, '#')").withColumn("row", F.row_number().over(Window.orderBy("ordinal"))).where("row <= 2")
    both = rows.agg(F.max(F.when(F.col("row") == 1, F.split("value", "\t"))).alias("names"), F.max(F.when(F.col("row") == 2, F.split("value", "\t"))).alias("values"))
    at = F.array_position("names", F.lit(column))
    return both.select(F.when(F.col("names").isNull(), 0).when(at == 0, -1).otherwise(F.get("values", (at - 1).cast("int")).cast("long")).cast("long").alias("n"))


def histogram_text(rows: list) -> str:
    """A histogram file: ``length``, ``n`` and whole percents, by themselves and summed up."""
    percent = lambda x: f"{round(100 * x)}%"
    lines = [f"{r.length}\t{r.n}\t{percent(r.share)}\t{percent(r.cumulative)}\n" for r in rows]
    return "".join(["Value \t Freq. \t Pct. \t Cum Pct. \n", *lines])


def key_from_path(path):
    """The file name cut at its first ``.bam`` (not at its start), else the whole name."""
    from ..functions.dna import _col

    name = F.element_at(F.split(_col(path), "/"), -1)
    return F.when(F.instr(name, ".bam") > 1, F.substring_index(name, ".bam", 1)).otherwise(name)
