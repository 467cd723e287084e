"""Per-sample counters: tidy ``key, label, label_ordinal, n`` rows beside one total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import WITHOUT_BARCODES, flatten_key, index_only, parse_key
from .sizes import sized


def count_labels(rows: DataFrame, key: str = "key", label: str = "label", ordinal: Column | None = None) -> DataFrame:
    """Counts by key and label (null keys belong to the total alone), labels numbered as first seen."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ordinal if ordinal is not None else F.col(label)).alias("__first")
    )
    order = Window.partitionBy("key").orderBy("__first", "label")
    return counted.select("key", "label", F.row_number().over(order).alias("label_ordinal"), "n")


def combine(*counters: DataFrame) -> DataFrame:
    """Counters added up by key and label; the first place of a label stays."""
    whole = counters[0].select("key", "label", "label_ordinal", "n")
    for other in counters[1:]:
        whole = whole.unionByName(other.select("key", "label", "label_ordinal", "n"))
    return whole.groupBy("key", "label").agg(F.min("label_ordinal").alias("label_ordinal"), F.sum("n").alias("n"))


def lookup(counter: DataFrame, key: str, label: str) -> DataFrame:
    """One row ``n``: the count of a key and label, 0 if absent."""
    return counter.where((F.col("key") == key) & (F.col("label") == label)).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"))


def same_counts(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of ``key, label, n``, whatever the order."""
    x, y = (c.select("key", "label", "n") for c in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def barcode_pair_counts(keyed: DataFrame) -> DataFrame:
    """First pass: of each index pair the counts of its barcode pairs.

    Labels are ``p5_p7`` or ``without_barcodes``, in the order in which pairs with a
    ``lane_id`` and ``ordinal`` show them; pairs without a key count in the total only.
    """
    seen = F.struct("lane_id", "ordinal") if {"lane_id", "ordinal"} <= set(keyed.columns) else F.lit(None).cast("long")
    flat = flatten_key("key")
    parts = parse_key(flat)
    label = F.when(parts["p5"].isNotNull() & parts["p7"].isNotNull(), F.concat_ws("_", parts["p5"], parts["p7"])).otherwise(WITHOUT_BARCODES)
    rows = keyed.where(F.col("key").isNotNull()).select(index_only(flat).alias("key"), label.alias("label"), seen.alias("seen"))
    return count_labels(rows, ordinal=F.col("seen"))


def barcode_lengths_from_counts(counter: DataFrame, lengths: DataFrame, threshold: float = 0.05) -> DataFrame:
    """``key, length`` by the barcode pair seen most for each index pair.

    ``lengths`` maps ``label`` to ``length`` (others are 0). Of equal counts the last in
    the file stays. If the top pair has no barcode and the next distinct count is more
    than ``threshold`` of it, that pair's length counts; two pairs without barcodes raise.
    """
    last = counter.groupBy("key", "n").agg(F.max_by("label", "label_ordinal").alias("label"))
    sides = last.select("key", "n", "label", F.split("label", "_").alias("sides"))
    for side in (0, 1):
        known = sized(lengths.select(F.col("label").alias(f"__l{side}"), F.col("length").alias(f"__n{side}")))
        sides = sides.join(known, F.get("sides", F.lit(side)) == F.col(f"__l{side}"), "left")
    pair = F.coalesce("__n0", F.lit(0))
    same = F.when(pair == F.coalesce("__n1", F.lit(0)), pair).otherwise(F.raise_error(F.lit("barcodes of a pair differ in length")).cast("int"))
    ranked = sides.withColumn("length", same).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"))))
    two = ranked.where("rank <= 2").groupBy("key").agg(
        *[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("n", "length")]
    )
    second = (F.col("length1") == 0) & (F.col("n2").cast("float") > F.lit(threshold).cast("float") * F.col("n1").cast("float"))
    checked = F.when(F.col("length2") > 0, F.col("length2")).otherwise(F.raise_error(F.lit("two pairs without barcodes")).cast("int"))
    return two.select("key", F.when(F.coalesce(second, F.lit(False)), checked).otherwise(F.col("length1")).alias("length"))


def rows_as_text(counter: DataFrame) -> DataFrame:
    """``key, line``: labels and counts in order, tab-separated; a key without labels stands alone."""
    pairs = F.array_sort(F.collect_list(F.struct("label_ordinal", "label", "n")))
    joined = F.flatten(F.transform(pairs, lambda x: F.array(x["label"], x["n"].cast("string"))))
    return counter.groupBy("key").agg(F.array_join(F.concat(F.array(F.first("key")), joined), "\t").alias("line"))


def sorted_text(counter: DataFrame, label: str = "raw") -> DataFrame:
    """``rank, key, line``: keys by descending count of ``label`` (missing: 0), then by key."""
    of = counter.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0)).alias("by"))
    out = rows_as_text(counter).join(of, "key")
    return out.orderBy(F.desc("by"), "key").select("by", "key", "line")


def select_samples(counter: DataFrame, file_ordinal: DataFrame, label: str = "raw", top: int = 1000, minimum: int = 1, threshold: int = -1) -> DataFrame:
    """Keys to split out: in file order the first ``top`` rows, or any that reach ``threshold``.

    Either way a key needs ``minimum`` counts. ``file_ordinal`` has ``key, ordinal`` from 0;
    rows that are refused count as well.
    """
    of = counter.where(F.col("label") == label).groupBy("key").agg(F.sum("n").alias("n"))
    rows = file_ordinal.join(of, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wanted = F.col("ordinal") < top
    if threshold >= 0:
        wanted |= F.col("n") >= threshold
    return rows.where(wanted & (F.col("n") >= minimum)).select("key", "ordinal")
