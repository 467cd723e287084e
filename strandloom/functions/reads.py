"""Reads as structs: construction with its checks, and equality of values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dna import _col, is_dna
from .headers import parse_header, same_header
from .keys import parse_key


def make_read(header: Column | str, seq: Column | str, qual: Column | str) -> Column:
    """Struct ``header, seq, qual`` of a read; null where ``seq`` is null.

    The header counts only if it starts with ``@``, else it is null. Letters that are no
    DNA, and a score more or less than there are bases, raise.
    """
    head, seq, qual = _col(header), _col(seq), _col(qual)
    parsed = F.when(head.startswith("@"), parse_header(head))
    read = F.struct(parsed.alias("header"), seq.alias("seq"), qual.alias("qual"))
    fits = is_dna(seq) & F.coalesce(F.char_length(seq) == F.char_length(qual), F.lit(False))
    return F.when(fits, read).when(seq.isNotNull(), F.raise_error(F.concat(F.lit("not a read: "), seq)).cast("void"))


def same_reads(a: Column, b: Column) -> Column:
    """Equal headers (or none on both sides), bases and scores."""
    heads = (a["header"].isNull() & b["header"].isNull()) | F.coalesce(same_header(a["header"], b["header"]), F.lit(False))
    return heads & a["seq"].eqNullSafe(b["seq"]) & a["qual"].eqNullSafe(b["qual"])


def same_keys(a: Column | str, b: Column | str) -> Column:
    """Equal part by part; what is no key equals only what is none either."""
    return parse_key(a).eqNullSafe(parse_key(b))


def same_merged(a_key: Column, a: Column, b_key: Column, b: Column) -> Column:
    """Merged reads are equal if their keys and their reads are."""
    return same_keys(a_key, b_key) & same_reads(a, b)
