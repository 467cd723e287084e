"""Barcode reference sets and nearest-barcode lookup."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dna import hamming, is_dna
from ..functions.keys import key_text
from .sizes import localized, sized


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df`` itself; a row for which ``ok`` is not true raises when it is read."""
    first, *rest = df.columns
    checked = F.when(F.coalesce(ok, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit(message)).cast(df.schema[first].dataType))
    return df.select(checked.alias(first), *rest)


def reference_set(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """``SET LABEL`` lines as ``label, ordinal, augmented_label, barcode, length``.

    A set is one or more ``:``-joined barcodes of one length, upper-cased; further
    columns and blank lines are ignored. The members of a larger set are labelled
    ``label.1``, ``label.2`` and so on. A repeated label or barcode, unequal lengths, a
    point in a label or letters other than ACGTN raise.
    """
    parts = F.split(F.trim(F.col(text_col)), r"\s+")
    rows = lines.where(F.trim(F.col(text_col)) != "").select(F.get(parts, F.lit(1)).alias("label"), F.split(F.upper(F.get(parts, F.lit(0))), ":").alias("members"))
    rows = require(rows, F.col("label").isNotNull() & ~F.col("label").contains("."), "a label is missing or has a point")
    members = F.col("members")
    rows = require(rows, F.forall(members, lambda m: F.char_length(m) == F.char_length(F.element_at(members, 1))), "barcodes of a set differ in length")
    rows = require(rows, F.forall(members, is_dna), "a barcode has letters other than ACGTN")
    # A reference set is a small dimension: it is checked as one row and taken apart again.
    one = rows.agg(F.array_sort(F.collect_list(F.struct("label", "members"))).alias("sets"))
    barcodes, labels = F.flatten(F.transform("sets", lambda x: x["members"])), F.transform("sets", lambda x: x["label"])
    once = (F.size(F.array_distinct(barcodes)) == F.size(barcodes)) & (F.size(F.array_distinct(labels)) == F.size(labels))
    each = require(one, once, "a barcode or label is there twice").select(F.explode("sets").alias("s"))
    each = each.select("s.label", F.size("s.members").alias("n"), F.posexplode("s.members").alias("at", "barcode"))
    labelled = F.when(F.col("n") > 1, F.concat_ws(".", "label", F.col("at") + 1)).otherwise(F.col("label"))
    out = each.select("label", (F.col("at") + 1).alias("ordinal"), labelled.alias("augmented_label"), "barcode", F.char_length("barcode").alias("length"))
    return localized(out)


def hamming_ball(reference: DataFrame, max_distance: int = 1, alphabet: str = "ACGTN") -> DataFrame:
    """``query, label``: every text within the distance, with its nearest augmented label.

    Of equally near labels the least counts. The ball of a 7-letter barcode has 29
    texts at distance 1 and 365 at distance 2.
    """
    if max_distance < 0:
        raise ValueError("the distance is not negative")
    bc = F.col("barcode")
    letters = F.array(*map(F.lit, alphabet))

    def spread(found: Column) -> Column:
        at = F.sequence(F.lit(1), F.char_length(bc))
        one = lambda x, i, c: F.concat(F.substring(x, F.lit(1), i - 1), c, F.substring(x, i + 1, F.char_length(x)))
        return F.array_distinct(F.flatten(F.transform(found, lambda x: F.flatten(F.transform(at, lambda i: F.transform(letters, lambda c: one(x, i, c)))))))

    ball = reference.where(F.char_length("barcode") > 0).select("augmented_label", "barcode", F.array("barcode").alias("found"))
    for _ in range(max_distance):
        ball = ball.withColumn("found", spread(F.col("found")))
    rows = ball.select("augmented_label", "barcode", F.explode("found").alias("query"))
    return rows.groupBy("query").agg(F.min(F.struct(hamming("query", "barcode").alias("distance"), F.col("augmented_label").alias("label"))).alias("best")).select(
        "query", F.col("best.label").alias("label"), F.col("best.distance").alias("distance")
    )


def nearest_label(reads: DataFrame, query: Column, reference: DataFrame, name: str, max_distance: int = 1) -> DataFrame:
    """``reads`` with the augmented label in ``name`` of the nearest barcode, or null.

    An equi-join with the Hamming ball: no pair of read and barcode is ever compared.
    Queries are upper-case ``ACGTN``; others find nothing, like too distant ones.
    """
    ball = hamming_ball(reference, max_distance).select(F.col("query").alias("__query"), F.col("label").alias(name))
    return reads.join(sized(ball), query == F.col("__query"), "left").drop("__query")


def nearest_label_by_search(reads: DataFrame, query: str, reference: DataFrame, name: str, max_distance: int = 1) -> DataFrame:
    """The same by comparing each distinct query with the reference set (any letters).

    For wide distances, whose balls would be large; the reference set is small and is
    broadcast behind a count.
    """
    ref = reference.select("augmented_label", "barcode", "length")
    queries = reads.select(F.col(query).alias("__query")).distinct()
    near = queries.join(sized(ref), F.char_length("__query") == F.col("length"))
    near = near.withColumn("__d", hamming("__query", "barcode")).where(F.col("__d") <= max_distance)
    best = near.groupBy("__query").agg(F.min(F.struct("__d", F.col("augmented_label").alias("label"))).alias("__best"))
    return reads.join(best, F.col(query).eqNullSafe(F.col("__query")), "left").withColumn(name, F.col("__best.label")).drop("__query", "__best")


def lengths_descending(reference: DataFrame) -> list[int]:
    """The distinct barcode lengths, longest first."""
    return [r.length for r in reference.select("length").distinct().orderBy(F.desc("length")).collect()]


def label_length(labels: DataFrame, label: str, reference: DataFrame, name: str) -> DataFrame:
    """Barcode length of a (flattened) label; 0 for an unknown one."""
    known = reference.where("ordinal = 1").select(F.col("label").alias("__label"), F.col("length").alias("__length"))
    return labels.join(sized(known), F.substring_index(F.col(label), ".", 1) == F.col("__label"), "left").withColumn(
        name, F.coalesce("__length", F.lit(0))
    ).drop("__label", "__length")


def experiment_keys(
    pairs: DataFrame, i5: DataFrame, i7: DataFrame, barcodes: DataFrame | None, max_distance: int = 1, chosen_length: Column | None = None,
    reverse_i5: bool = False,
) -> DataFrame:
    """``pairs`` (``r1_seq, r2_seq`` and ``i1_seq, i2_seq`` or ``i7_label, i5_label``) with ``key``.

    Index read 1 is i7 and index read 2 i5; without both labels the key is null. The
    longest barcode length at which both read starts match gives p5 and p7, else the
    key is of the index pair alone. ``chosen_length`` (0 or more) allows that length only.
    """
    from ..functions.dna import reverse_complement

    out = pairs
    if "i5_label" not in pairs.columns:
        turned = reverse_complement("i2_seq") if reverse_i5 else F.col("i2_seq")
        out = nearest_label(out, turned, i5, "i5_label", max_distance)
        out = nearest_label(out, F.col("i1_seq"), i7, "i7_label", max_distance)
    found5, found7 = F.lit(None).cast("string"), F.lit(None).cast("string")
    names = []
    for n in lengths_descending(barcodes) if barcodes is not None else []:
        of_length = barcodes.where(F.col("length") == n)
        for read, side in (("r1_seq", "5"), ("r2_seq", "7")):
            start = F.when(F.char_length(read) >= n, F.left(F.col(read), F.lit(n))).otherwise(F.raise_error(F.lit("barcode longer than its read")).cast("string"))
            wanted = F.col("i5_label").isNotNull() & F.col("i7_label").isNotNull()
            if chosen_length is not None:
                wanted &= (chosen_length == n) | (chosen_length < 0)
            out = nearest_label(out, F.when(wanted, start), of_length, f"__p{side}_{n}", max_distance)
            names.append(f"__p{side}_{n}")
        both = F.col(f"__p5_{n}").isNotNull() & F.col(f"__p7_{n}").isNotNull()
        found5 = F.when(found5.isNull() & both, F.col(f"__p5_{n}")).otherwise(found5)
        found7 = F.when(found7.isNull() & both, F.col(f"__p7_{n}")).otherwise(found7)
    return out.withColumn("key", key_text(F.col("i5_label"), F.col("i7_label"), found5, found7)).drop(*names)
