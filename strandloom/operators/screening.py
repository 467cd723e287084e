"""The screening pass: keys, merge, counts and striped output for read pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dna import let
from ..functions.headers import header_text, parse_header, read_group, same_but_read
from ..functions.keys import flatten_key, index_only, parse_key
from ..functions.merging import MergeParams, is_oligo, merge_pairs
from ..sources.places import written
from .barcodes import experiment_keys, label_length
from .counts import count_labels
from .sizes import sized


def _alike(a: Column, b: Column) -> Column:
    """Texts that differ in the read number at most, so that only one need be parsed; false says nothing."""
    bare = lambda x: F.regexp_replace(x, " [0-9]+:", " :")
    return F.coalesce((a == b) | (~a.contains("/") & (bare(a) == bare(b))), F.lit(False))


def check_headers(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``h1`` parsed; headers that differ in more than the read number raise."""
    others = [c for c in ("r2_header", "i1_header", "i2_header") if c in pairs.columns]
    h1 = parse_header("r1_header")

    def checked(x: Column) -> Column:
        same = x.isNotNull()
        for c in others:
            same &= F.when(_alike(F.col("r1_header"), F.col(c)), True).otherwise(F.coalesce(same_but_read(x, parse_header(c)), F.lit(False)))
        return F.when(same, x).otherwise(F.raise_error(F.lit("headers of a pair differ")))

    kind = pairs.select(h1.alias("h")).schema["h"].dataType
    return pairs.withColumn("h1", let(h1, lambda x: checked(x).cast(kind)))


def decide_lengths(keyed: DataFrame, sheet: DataFrame | None, prior: DataFrame | None) -> DataFrame:
    """``keyed`` (index-only ``key``) with the barcode ``length`` to look for.

    The sample sheet (``key, length``) comes first, then the prior counts' decision.
    Without prior counts neither is asked and the length is -1: no barcodes.
    """
    if prior is None:
        return keyed.withColumn("length", F.lit(-1))
    known = prior.select("key", F.col("length").alias("__prior"))
    out = keyed.join(sized(known), "key", "left")
    if sheet is not None:
        out = out.join(sized(sheet.select("key", F.col("length").alias("__sheet"))), "key", "left")
    else:
        out = out.withColumn("__sheet", F.lit(None).cast("int"))
    return out.withColumn("length", F.coalesce("__sheet", "__prior", F.lit(-1))).drop("__sheet", "__prior")


def keyed_pairs(
    pairs: DataFrame, i5: DataFrame, i7: DataFrame, barcodes: DataFrame, prior_lengths: DataFrame | None = None, sheet: DataFrame | None = None,
    max_distance: int = 1, reverse_i5: bool = False,
) -> DataFrame:
    """One row a pair: ``key`` (flattened), ``full_key, read_group`` and the header, nothing merged.

    Pairs whose labels are given (``i5_label, i7_label``) may have barcodes of any
    length; others only of the length decided for their index pair.
    """
    fixed = "i5_label" in pairs.columns
    # A lane is one unsplittable file and merging is costly, so pairs are dealt out first.
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checked = check_headers(pairs.repartition(n, "lane_id", "ordinal"))
    if fixed:
        keyed = experiment_keys(checked, i5, i7, barcodes, max_distance)
    else:
        only = experiment_keys(checked, i5, i7, None, max_distance, reverse_i5=reverse_i5)
        only = only.withColumn("__full", F.col("key")).withColumn("key", index_only(flatten_key("key")))
        decided = decide_lengths(only, sheet, prior_lengths).withColumn("key", F.col("__full")).drop("__full")
        # A length of -1 stands for no barcodes here, so nothing may match.
        chosen = F.when(F.col("length") > 0, F.col("length")).otherwise(0)
        keyed = experiment_keys(decided, i5, i7, barcodes, max_distance, chosen).drop("length")
    keyed = keyed.withColumn("full_key", F.col("key")).withColumn("key", flatten_key("key"))
    return keyed.withColumn("read_group", F.when(F.col("key").isNotNull(), read_group(F.col("h1"))))


def screen_pairs(
    pairs: DataFrame, i5: DataFrame, i7: DataFrame, barcodes: DataFrame, prior_lengths: DataFrame | None = None, sheet: DataFrame | None = None,
    oligo: str | None = None, max_distance: int = 1, reverse_i5: bool = False, params: MergeParams | None = None,
) -> DataFrame:
    """``keyed_pairs`` with ``merged_seq, merged_qual, oligo``."""
    keyed = keyed_pairs(pairs, i5, i7, barcodes, prior_lengths, sheet, max_distance, reverse_i5)
    parts = parse_key("key")
    keyed = keyed.withColumns({"__p5": parts["p5"], "__p7": parts["p7"]})
    keyed = label_length(label_length(keyed, "__p5", barcodes, "__n5"), "__p7", barcodes, "__n7")
    merged = merge_pairs(keyed, F.col("__n5"), F.col("__n7"), params, F.col("key").isNotNull())
    hit = F.lit(False) if oligo is None else is_oligo(F.col("merged_seq"), F.col("merged_qual"), oligo, params)
    return merged.withColumn("oligo", hit).drop("__p5", "__p7", "__n5", "__n7")


def screen_counts(screened: DataFrame) -> DataFrame:
    """Counters ``raw``, ``oligo`` and ``merged`` of each key.

    Every keyed pair is raw; merged reads count if they pass the chastity filter, and as
    oligos even if they don't.
    """
    kept = F.col("merged_seq").isNotNull()
    each = screened.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("raw"), F.sum((kept & F.col("oligo")).cast("long")).alias("oligo"), F.sum((kept & ~F.col("h1.filtered")).cast("long")).alias("merged")
    )
    rows = each.select("key", F.posexplode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in ("raw", "oligo", "merged")])).alias("label_ordinal", "x"))
    return rows.select("key", "x.label", F.col("label_ordinal") + 1, "x.n").toDF("key", "label", "label_ordinal", "n").where("n > 0")


def check_read_groups(keyed: DataFrame) -> DataFrame:
    """One row ``read_group``: of the first keyed pair; raises if keyed pairs have several."""
    found = keyed.where(F.col("key").isNotNull()).agg(F.min_by("read_group", F.struct("lane_id", "ordinal")).alias("read_group"), F.min("read_group").alias("a"), F.max("read_group").alias("b"))
    return found.select(F.when(F.coalesce(F.col("a") == F.col("b"), F.lit(True)), F.coalesce("read_group", F.lit("null"))).otherwise(F.raise_error(F.lit("several read groups")).cast("string")).alias("read_group"))


def striped(screened: DataFrame, stripes: int = 25, stretch: int = 1 << 20) -> DataFrame:
    """Written reads ``stripe, lane_id, ordinal, header, seq, qual``, dealt out in turn in each lane.

    A read's turn is its place among the written ones of its lane. Places are counted by
    stretches of so many ordinals first, so no task sorts a lane; the reads are written
    once in between, so that none is merged twice.
    """
    kept = screened.where(F.col("merged_seq").isNotNull() & ~F.col("h1.filtered")).select(
        "lane_id", "ordinal", header_text(F.col("h1"), F.col("full_key")).alias("header"), F.col("merged_seq").alias("seq"), F.col("merged_qual").alias("qual")
    )
    kept = written(kept, "striped").withColumn("__stretch", F.floor(F.col("ordinal") / stretch))
    upto = Window.partitionBy("lane_id").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = kept.groupBy("lane_id", "__stretch").agg(F.count(F.lit(1)).alias("n")).select(
        "lane_id", "__stretch", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__before")
    )
    place = F.row_number().over(Window.partitionBy("lane_id", "__stretch").orderBy("ordinal")) - 1 + F.col("__before")
    return kept.join(sized(before), ["lane_id", "__stretch"]).select((place % stripes + 1).alias("stripe"), "lane_id", "ordinal", "header", "seq", "qual")


def total(rows: DataFrame) -> DataFrame:
    """One row ``total``: all pairs, keyed or not."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def label_counts(rows: DataFrame, ordinal: Column | None = None) -> DataFrame:
    return count_labels(rows, ordinal=ordinal)
