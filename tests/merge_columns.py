"""Merging of read pairs as Column expressions: the slow version that the fast one is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.functions.dna import let, phred, phred_text, reverse_complement, trim_to, trim_unknown
from strandloom.functions.merging import MAX_QUALITY, MergeParams


def alignment_passes(a: Column, a_scores: Column, b: Column, b_scores: Column, a_at: Column, b_at: Column, min_overlap: Column | int, p: MergeParams) -> Column:
    """Whether two stretches agree: at every mismatch the penalty so far is within its limit.

    Sequences are arrays of letters. Up to ``min_overlap`` positions the limit is
    ``max_penalty``, beyond them it grows in proportion. No overlap passes.
    """
    limit = F.lit(min_overlap) if isinstance(min_overlap, int) else min_overlap
    n = F.least(F.size(a) - a_at, F.size(b) - b_at)
    start = F.struct(F.lit(0).alias("penalty"), F.lit(True).alias("ok"))

    def step(state: Column, i: Column) -> Column:
        differ = F.get(a, a_at + i) != F.get(b, b_at + i)
        sure = (F.get(a_scores, a_at + i) >= p.quality_threshold) & (F.get(b_scores, b_at + i) >= p.quality_threshold)
        penalty = state["penalty"] + F.when(~differ, 0).when(sure, p.penalty_high).otherwise(p.penalty_low)
        over = F.when(i <= limit, penalty > p.max_penalty).otherwise(penalty * limit > i * p.max_penalty)
        return F.struct(penalty.alias("penalty"), (state["ok"] & (~differ | ~over)).alias("ok"))

    positions = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n)
    return F.aggregate(positions, start, step, lambda s: s["ok"])


def passing_offsets(a: Column, a_scores: Column, b: Column, b_scores: Column, p: MergeParams) -> Column:
    """Offsets of ``b`` against ``a`` that pass, from the least overlap down."""
    high, low = F.size(a) - p.min_overlap, F.lit(p.min_length) - F.size(b)
    tried = F.when(high >= low, F.sequence(high, low, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.filter(
        tried,
        lambda o: alignment_passes(a, a_scores, b, b_scores, F.greatest(o, F.lit(0)), F.greatest(-o, F.lit(0)), p.min_overlap, p),
    )


def _merged(a: Column, a_scores: Column, b: Column, b_scores: Column, offset: Column) -> Column:
    """Array of ``(base, score)`` of the merged read, as long as ``b`` reaches."""
    n = F.size(b) + offset

    def at(i: Column) -> Column:
        x, q = F.get(a, i), F.get(a_scores, i)
        y, r = F.get(b, F.greatest(i - offset, F.lit(0))), F.get(b_scores, F.greatest(i - offset, F.lit(0)))
        both = F.when(x == y, F.struct(F.upper(x).alias("base"), F.least(F.greatest(q, r), F.lit(MAX_QUALITY)).alias("score"))).otherwise(
            F.struct(F.upper(F.when(q >= r, x).otherwise(y)).alias("base"), F.abs(r - q).alias("score"))
        )
        only = lambda base, score: F.struct(base.alias("base"), score.alias("score"))
        return F.when(i < offset, only(x, q)).when(i < F.size(a), both).otherwise(only(y, r))

    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n), at)


def merge_pairs(pairs: DataFrame, r1_barcode: Column, r2_barcode: Column, params: MergeParams | None = None) -> DataFrame:
    """``pairs`` (with ``r1_seq, r1_qual, r2_seq, r2_qual``) and ``merged_seq, merged_qual``.

    Barcodes of the given lengths are cut off, trailing unknown bases trimmed, read 2
    reverse-complemented; the pair merges if exactly one alignment passes, which also
    trims adapters, else both columns are null. A barcode longer than its read raises.
    """
    p = params or MergeParams()
    long_enough = (r1_barcode <= F.char_length("r1_seq")) & (r2_barcode <= F.char_length("r2_seq"))
    rest = lambda c, n: F.substring(c, n + 1, F.char_length(c))
    letters = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    a = F.when(long_enough, trim_unknown(rest(F.col("r1_seq"), r1_barcode))).otherwise(F.raise_error(F.lit("barcode longer than its read")).cast("string"))
    trimmed = F.struct(
        a.alias("a"), rest(F.col("r1_qual"), r1_barcode).alias("aq"), trim_unknown(rest(F.col("r2_seq"), r2_barcode)).alias("b"), rest(F.col("r2_qual"), r2_barcode).alias("bq")
    )

    # Every step is bound once by ``let``: a filter on the result that is pushed down
    # repeats the whole expression, but no part of it inside another.
    def arrays(t: Column) -> Column:
        return F.struct(
            letters(t["a"]).alias("a"), phred(trim_to(t["aq"], t["a"])).alias("aq"), letters(reverse_complement(t["b"])).alias("b"),
            F.reverse(phred(trim_to(t["bq"], t["b"]))).alias("bq"),
        )

    def aligned(x: Column) -> Column:
        parts = [x[c] for c in ("a", "aq", "b", "bq")]
        found = let(passing_offsets(*parts, p), lambda o: F.when(F.size(o) == 1, F.element_at(o, 1)))
        return let(found, lambda o: F.when(o.isNotNull(), let(_merged(*parts, o), written)))

    def written(m: Column) -> Column:
        return F.struct(F.array_join(F.transform(m, lambda x: x["base"]), "").alias("seq"), phred_text(F.transform(m, lambda x: x["score"])).alias("qual"))

    merged = let(trimmed, lambda t: let(arrays(t), aligned))
    out = pairs.withColumn("__merged", merged)
    return out.withColumns({"merged_seq": F.col("__merged.seq"), "merged_qual": F.col("__merged.qual")}).drop("__merged")


def is_oligo(seq: Column, qual: Column, oligo: str, params: MergeParams | None = None) -> Column:
    """The start of a merged read agrees with the oligo or its reverse complement."""
    p = params or MergeParams()
    turned = oligo[::-1].translate(str.maketrans("ACGTNacgtn", "TGCANtgcan"))
    hits = [
        alignment_passes(
            F.array(*map(F.lit, text)), F.array_repeat(F.lit(40), len(text)), F.split(seq, ""), phred(qual), F.lit(0), F.lit(0), len(text), p
        )
        for text in (oligo, turned)
    ]
    return F.coalesce(hits[0] | hits[1], F.lit(False))
