"""Sequences and qualities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Phred scores are stored as text, score + 33.
PHRED_OFFSET = 33
_ALPHABET = "^[ACGTNacgtn]*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_dna(seq: Column | str) -> Column:
    """Only ``ACGTN`` in either case; null for null."""
    return _col(seq).rlike(_ALPHABET)


def checked_dna(seq: Column | str) -> Column:
    """The sequence itself; a run-time error for any other letter."""
    seq = _col(seq)
    return F.when(seq.isNull() | is_dna(seq), seq).otherwise(F.raise_error(F.concat(F.lit("not a DNA sequence: "), seq)).cast("string"))


def reverse_complement(seq: Column | str) -> Column:
    """Case is kept and N stays N."""
    return F.reverse(F.translate(_col(seq), "ACGTNacgtn", "TGCANtgcan"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing positions, case-sensitive, N like any letter; other lengths raise."""
    a, b = _col(a), _col(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    same_length = F.char_length(a) == F.char_length(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(
        same_length, F.aggregate(pairs, F.lit(0), lambda n, x: n + x)
    ).otherwise(F.raise_error(F.lit("sequences of different lengths")).cast("int"))


def phred(qual: Column | str) -> Column:
    """Quality text as an array of scores."""
    qual = _col(qual)
    return F.when(qual == "", F.array().cast("array<int>")).otherwise(
        F.transform(F.split(qual, ""), lambda c: F.ascii(c) - PHRED_OFFSET)
    )


def phred_text(scores: Column | str) -> Column:
    return F.array_join(F.transform(_col(scores), lambda q: F.char((q + PHRED_OFFSET).cast("long"))), "")


def error_probability(score: Column | str) -> Column:
    """10 to the power of minus a tenth of the score."""
    return F.pow(F.lit(10.0), -_col(score) / F.lit(10.0))


def subsequence(seq: Column | str, begin: int | Column, end: int | Column) -> Column:
    """Letters ``begin`` up to ``end`` (from 0); bounds outside the sequence raise."""
    seq, begin, end = _col(seq), *(x if isinstance(x, Column) else F.lit(x) for x in (begin, end))
    inside = (begin >= 0) & (begin <= end) & (end <= F.char_length(seq))
    return F.when(seq.isNull(), seq).when(inside, F.substring(seq, begin + 1, end - begin)).otherwise(
        F.raise_error(F.lit("subsequence out of range")).cast("string")
    )


def trim_unknown(seq: Column | str) -> Column:
    """Without trailing N or n."""
    return F.regexp_replace(_col(seq), "[Nn]+$", "")


def trim_to(qual: Column | str, seq: Column) -> Column:
    """Quality text cut to the length of ``seq``."""
    return F.left(_col(qual), F.char_length(seq))


def read_is_valid(seq: Column | str, qual: Column | str) -> Column:
    """A read has DNA letters and as many scores as bases."""
    return is_dna(seq) & (F.char_length(_col(seq)) == F.char_length(_col(qual)))
